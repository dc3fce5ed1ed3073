"""What declarations, references and comments look like in each language; tables for skein.extract.source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_N = r"(?P<name>[A-Za-z_$][\w$]*)"


@dataclass(frozen=True)
class Language:
    """declare: (kind, pattern with a group `name`); a pattern's start is the declaration's first line.

    heads: (edge kind, pattern with a group `to`), read on declarations of classes; imports: patterns
    with `to` and perhaps `names`; blocks: '{' or 'indent'.
    """

    comment: str
    strings: str
    declare: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]
    heads: tuple[tuple[str, str], ...] = ()
    types: str | None = None
    cases: str | None = None
    self_words: tuple[str, ...] = ()
    blocks: str = "{"
    member_kind: dict[str, str] = field(default_factory=dict)
    keywords: frozenset[str] = frozenset()


_SLASH = r"//[^\n]*|/\*.*?\*/"
_QUOTES = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_KEYS = frozenset(
    "if for while switch catch return new throw else do try case await yield typeof instanceof in of delete void super this function class interface enum struct"
    " def lambda not and or is with assert print except elif match fn let mut const static pub use mod impl trait type where as loop unsafe move ref dyn async go defer select"
    " chan map range func var package import public private protected internal override virtual abstract sealed readonly get set using namespace base lock sizeof nameof".split()
)
_MODS = r"(?:(?:export|default|declare|abstract|public|private|protected|internal|static|async|final|sealed|virtual|override|partial|readonly|synchronized|native|unsafe|extern|new)\s+)*"
_TYPE = r"[\w$.]+(?:\s*<[^(){};=]*?>)?(?:\[\])*\??"

LANGUAGES: dict[str, Language] = {
    "typescript": Language(
        comment=_SLASH,
        strings=_QUOTES + r"|`(?:\\.|[^`\\])*`",
        declare=(
            ("class", rf"^[ \t]*{_MODS}class\s+{_N}"),
            ("interface", rf"^[ \t]*{_MODS}interface\s+{_N}"),
            ("enum", rf"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+{_N}"),
            ("type", rf"^[ \t]*(?:export\s+)?type\s+{_N}(?:<[^=]*>)?\s*="),
            ("function", rf"^[ \t]*{_MODS}function\s*\*?\s*{_N}"),
            ("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+{_N}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"),
            ("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+{_N}\s*=\s*(?:async\s+)?function\b"),
            ("method", rf"^[ \t]+{_MODS}(?:get\s+|set\s+)?\*?{_N}\s*(?:<[^(){{}}]*>)?\([^(){{}};]*(?:\([^()]*\)[^(){{}};]*)*\)\s*(?::[^{{;=]+)?\{{"),
            ("property", rf"^[ \t]+{_MODS}{_N}[?!]?\s*(?::[^;=(){{}}\n]+)?(?:=[^;\n]*)?;"),
        ),
        imports=(r"import\s+(?:type\s+)?\{(?P<names>[^}]*)\}\s*from\s*(?P<to>['\"][^'\"]+['\"])",),
        heads=(("extends", r"\bextends\s+(?P<to>[\w$.]+)"), ("implements", r"\bimplements\s+(?P<to>[^{]+)")),
        types=r":\s*(?P<to>[A-Z][\w$]*)(?=\s*[,;)={\n|&])",
        self_words=("this", "super"),
    ),
    "csharp": Language(
        comment=_SLASH,
        strings=r'[@$]*"(?:\\.|""|[^"\\])*"|\'(?:\\.|[^\'\\\n])*\'',
        declare=(
            ("class", rf"^[ \t]*{_MODS}(?:class|record)\s+{_N}"),
            ("interface", rf"^[ \t]*{_MODS}interface\s+{_N}"),
            ("struct", rf"^[ \t]*{_MODS}struct\s+{_N}"),
            ("enum", rf"^[ \t]*{_MODS}enum\s+{_N}"),
            ("type", rf"^[ \t]*{_MODS}delegate\s+{_TYPE}\s+{_N}"),
            ("method", rf"^[ \t]+{_MODS}(?:{_TYPE}\s+)?{_N}\s*(?:<[^(){{}}]*>)?\([^(){{}};]*\)\s*(?::\s*(?:base|this)\([^()]*\)\s*)?(?:\{{|=>|;)"),
            ("property", rf"^[ \t]+{_MODS}{_TYPE}\s+{_N}\s*(?:\{{\s*(?:get|set|init)|=>)"),
        ),
        imports=(r"^[ \t]*using\s+(?:static\s+)?(?P<to>[\w.]+)\s*;",),
        heads=(("implements", r"(?:class|record|struct|interface)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*(?P<to>[^{]+)"),),
        cases=r"\bcase\s+\w+(?:\.\w+)*\.(?P<to>\w+)\s*:",
        self_words=("this", "base"),
    ),
    "python": Language(
        comment=r"#[^\n]*",
        strings=r'[rbfuRBFU]*"""(?:\\.|[^\\])*?"""|[rbfuRBFU]*\'\'\'(?:\\.|[^\\])*?\'\'\'|' + _QUOTES,
        declare=(("class", rf"^[ \t]*class\s+{_N}"), ("function", rf"^[ \t]*(?:async\s+)?def\s+{_N}")),
        imports=(r"^[ \t]*from\s+(?P<to>[\w.]+)\s+import\s+(?P<names>\([^)]*\)|[^\n]+)", r"^[ \t]*import\s+(?P<to>[\w.]+)"),
        heads=(("extends", r"class\s+\w+\s*\((?P<to>[^)]*)\)"),),
        blocks="indent",
    ),
    "go": Language(
        comment=_SLASH,
        strings=_QUOTES + r"|`[^`]*`",
        declare=(
            ("method", rf"^func\s*\([^)]*\)\s*{_N}"),
            ("function", rf"^func\s+{_N}"),
            ("struct", rf"^type\s+{_N}\b"),
            ("const", rf"^const\s+{_N}\b"),
        ),
        imports=(r'^[ \t]*import\s+(?:[\w.]+\s+)?(?P<to>"[^"]+")', r"^[ \t]*import\s*\((?P<names>[^)]*)\)(?P<to>)"),
        heads=(("extends", r"(?:^|\n)[ \t]+(?:\w+[ \t]+)?\*?(?P<to>[A-Za-z_]\w*)[ \t]*(?=\n|`)"),),
    ),
    "java": Language(
        comment=_SLASH,
        strings=_QUOTES,
        declare=(
            ("class", rf"^[ \t]*{_MODS}(?:class|record)\s+{_N}"),
            ("interface", rf"^[ \t]*{_MODS}interface\s+{_N}"),
            ("enum", rf"^[ \t]*{_MODS}enum\s+{_N}"),
            ("type", rf"^[ \t]*{_MODS}@interface\s+{_N}"),
            ("method", rf"^[ \t]+{_MODS}(?:<[^(){{}}]*>\s*)?(?:{_TYPE}\s+)?{_N}\s*\([^(){{}};]*\)\s*(?:throws\s+[\w., ]+)?(?:\{{|;)"),
            ("property", rf"^[ \t]+{_MODS}{_TYPE}\s+{_N}\s*(?:=[^;]*)?;"),
        ),
        imports=(r"^[ \t]*import\s+(?:static\s+)?(?P<to>[\w.]+(?:\.\*)?)\s*;",),
        heads=(("extends", r"\bextends\s+(?P<to>[^{]+?)(?=\bimplements\b|\{|$)"), ("implements", r"\bimplements\s+(?P<to>[^{]+)")),
        types=r"(?:[(,]\s*(?:final\s+)?|^[ \t]+(?:(?:private|public|protected|static|final)\s+)+)(?P<to>[A-Z]\w*)(?=\s+\w+\s*[,);=])",
        cases=r"\bcase\s+(?P<to>[A-Z_]\w*)\s*(?::|->)",
        self_words=("this", "super"),
    ),
    "rust": Language(
        comment=_SLASH,
        strings=r'b?"(?:\\.|[^"\\])*"|b?\'(?:\\.|[^\'\\\n])\'',
        declare=(
            ("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+{_N}"),
            ("struct", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_N}"),
            ("enum", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_N}"),
            ("interface", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_N}"),
            ("type", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+{_N}"),
            ("const", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?{_N}\s*:"),
        ),
        imports=(r"^[ \t]*(?:pub\s+)?use\s+(?P<to>[^;]+);",),
        types=r"(?::|->)\s*&?(?:mut\s+)?(?P<to>[A-Z]\w*)",
        cases=r"(?:^|\n)[ \t]*(?:\w+::)+(?P<to>[A-Z]\w*)[^=\n]*=>",
    ),
}


def keyword(word: str) -> bool:
    return word in _KEYS


def patterns(language: Language) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p, re.M)) for kind, p in language.declare]
