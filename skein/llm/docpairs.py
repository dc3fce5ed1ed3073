"""Functions paired with their documentation (problem 5).

A docstring is reduced to its description: comment marks, markup and tagged
parts go. Functions whose description is empty or trivial look for one up their
class hierarchy: the hierarchy is read from the extends and implements edges, and
overridden methods are joined level by level until nothing more resolves.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.scale import checkpoint, left_join_skewed
from skein.session import ship_package
from skein.tables import CLASS_LIKE, current_symbols

_OPEN = re.compile(r"^\s*(?:/\*[*!]?|\"\"\"|'''|<!--|\{-|\(\*)")
_CLOSE = re.compile(r"(?:\*+/|\"\"\"|'''|-->|-\}|\*\))\s*$")
_LINE = re.compile(r"^[ \t]*(?://[/!]?|\*(?![*\w]))[ \t]?")
_HASH = re.compile(r"^[ \t]*#[#:!]?[ \t]?")

#: Tags and section names whose text is not description.
_TAGGED = re.compile(
    r"^[ \t]*[@\\](?:param|arg|argument|property|prop|returns?|result|retval|throws?|exception|raises|yields?|deprecated|see|since|author"
    r"|version|typeparam|tparam|template|type|todo|example|link|category|module|memberof|default|defaultvalue|internal|private|public"
    r"|protected|static|readonly|async|generator|callback|fires|emits|listens|group|throwable|serial\w*)\b",
    re.I,
)
_FIELD = re.compile(r"^[ \t]*:(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|var|ivar|cvar|vartype|returns?|rtype|yields?|ytype|deprecated|meta)\b[^:\n]*:", re.I)
_SECTION = re.compile(
    r"^[ \t]*(?:args|arguments|parameters|params|keyword args|keyword arguments|other parameters|returns?|return value|yields?|raises|throws|exceptions|errors|panics"
    r"|safety|attributes|deprecated|see also|type parameters)[ \t]*:[ \t]*$",
    re.I,
)
_HEADING = re.compile(
    r"^[ \t]*(?:#+[ \t]*|\*\*)(?:arguments|args|parameters|params|returns?|return value|errors|panics|safety|examples?|see also|deprecated|type parameters)\b[ \t:*]*$", re.I
)
_UNDERLINED = re.compile(r"^[ \t]*(?:parameters|returns|yields|raises|other parameters|see also|examples?|attributes)[ \t]*\n[ \t]*-{3,}[ \t]*$", re.I | re.M)
_DEPRECATED = re.compile(r"^[ \t]*(?:\.\. )?deprecated(?:::|:|[ \t]+since\b)", re.I)
_XML_PART = re.compile(
    r"<(param|typeparam|returns?|exception|value|permission|seealso|example)\b[^>]*?(?:/>|>.*?</\1\s*>)", re.I | re.S
)
_MARKUP = re.compile(r"</?(?:summary|remarks|para|p|b|i|u|em|strong|code|c|pre|tt|br|ul|ol|li|div|span|h[1-6]|a|see|paramref|typeparamref|item|list|description)\b[^<>]*>", re.I)
_INLINE = re.compile(r"\{@(?:code|literal|link|linkplain|value|tutorial)\s+([^{}]*)\}")

#: Texts that say nothing, in the forms in which they are left in sources.
_PLACEHOLDER = re.compile(
    r"(?:todo|fixme|xxx|tbd|tba|wip|hack)\b.*|n/?a|none|null|nil|description|<?description>?|\[?description\]?|desc|\?+|…|lorem ipsum.*"
    r"|(?:please )?(?:add|insert|write|put|enter|fill in)(?: a| the| your)? ?(?:description|docs?|documentation|comment|summary|text)s?\b.*"
    r"|(?:no|missing|undocumented|without)(?: description| documentation| docs?| comment| javadoc)?(?: available| provided| yet| here| given)?"
    r"|(?:description|documentation|docs?|comment) (?:missing|pending|needed|to (?:be (?:added|written|done)|come|follow)|follows|goes here|here)"
    r"|to be (?:documented|written|done|added|defined|determined|completed)|not (?:yet )?documented(?: yet)?|undocumented|document (?:me|this)|placeholder"
    r"|coming soon|auto-?generated(?: .*)?|generated (?:method|constructor|function) stub|stub"
    r"|beschreibung (?:folgt|fehlt)|folgt(?: noch)?|noch zu (?:schreiben|dokumentieren|erledigen)|kommt noch|keine beschreibung|dokumentation (?:folgt|fehlt)"
    r"|[àa] (?:compl[ée]ter|faire|documenter|d[ée]finir|venir)|pas de description|sans description|description [àa] (?:venir|compl[ée]ter)"
    r"|pendiente(?: de .*)?|por (?:hacer|documentar|completar|definir)|sin (?:descripci[oó]n|documentar)|descripci[oó]n pendiente"
    r"|未(?:記入|記載|定|実装|稿)|説明(?:なし|待ち|を追加)?|後で(?:書く|記入|追記)?|要(?:記入|追記|説明)|記述なし|準備中|待定|待补充|暂无",
    re.I,
)
_POINTER = re.compile(
    r"\{@inheritdoc[^}]*\}|[@\\]?inherit-?doc(?:s|umentation)?|<inheritdoc\b[^>]*/?>(?:</inheritdoc>)?|[@\\]override[sn]?|@see\b.*|see also:?\s.*|override[sn]?"
    r"|(?:documentation |doc |docs )?inherited(?: documentation| docs?)? from\b.*|\(?inherited\)?|inherit(?:s|ed)? (?:doc|documentation).*"
    r"|(?:same as|see|refer to|as in|like|cf\.?)(?: the| its)? (?:base|super|parent|interface|overridden|inherited|implemented)\b.*"
    r"|(?:implements|overrides|implementation of|override of|documented in|defined in|specified by|description copied from)\b[^.]*"
    r"|(?:siehe|voir|véase|ver) (?:basis|ober|classe|clase|la classe|la clase|interface)\w*.*|see [`\w.#:]+[#.:]\w+(?:\(\))?",
    re.I,
)
_DIRECTIVE = re.compile(
    r"(?:noinspection|eslint(?:-\w+)*|tslint|prettier-\w+|istanbul|pylint|pyright|mypy|flake8|ruff|noqa|isort|fmt|yapf|type|pragma|nolint|nosec|nosonar|checkstyle|spotless"
    r"|go|clippy|rustfmt|allow|resharper|stylecop|sonar|coverage|c8|v8|jshint|jslint|jscs|@ts-\w+|@formatter|language|lint|codecov|semgrep|biome-ignore|deno-\w+|cspell|spell-?checker)"
    r"(?:\s*[:=(].*|\s+(?:disable|enable|ignore|off|on|skip|unused|next|file|no|once|all)\b.*|[:-]?(?:off|on|ignore|disable\S*|skip))?"
    r"|(?:#|//)?(?:end)?region\b.*|#?\s*(?:pragma|warning|nullable|if|endif|define|undef|line)\b.*|@(?:ts-|suppress|formatter:|internal|generated|noinspection|nocover|phpcs|codecoverage|hidden|ignore|no\w+)\S*.*"
    r"|@[a-z-]+|\+build .*|nolint\S*|@?suppresswarnings\b.*|#\[.*\]|-\*-.*-\*-|vim?:.*|coding[:=].*|editorconfig.*|go:\w+.*",
    re.I,
)
_LICENCE = re.compile(
    r"spdx-license-identifier\b.*|(?:\(c\)|©|copyright).*|licen[sc]ed (?:under|to)\b.*|.*\ball rights reserved\b.*|licen[sc]e:? .*|"
    r"(?:mit|apache|bsd|gpl|lgpl|mpl|isc)[- ]?(?:license|licence|v?\d[\d.]*)?\.?",
    re.I,
)
_CODE = re.compile(
    r"(?:[\w\]\)>.]+\s*(?:[-+*/|&]?=|:=)\s*\S.*;?|(?:(?:const|let|var|val|auto|final|static|mut|let mut)\s+)[\w<>\[\], ]+\s*(?::=|=).*"
    r"|(?:return|throw|raise|yield|await|break|continue|pass|goto|defer|del|assert|print\w*|console|fmt|System|log(?:ger)?)\b[ .(!].*[;)\]}]?"
    r"|(?:return|break|continue|pass);?|(?:if|for|while|switch|match|else if|elif|catch|try|with|foreach)\s*\(.*|(?:if|for|while|elif|match|switch)\b.*[:{;]\s*|else:?|\}?\s*else\s*\{?"
    r"|[\w.$:>\-\[\]]+!?(?:<[\w<>, ]*>)?\(.*\)\s*[;{,]?|(?:[\w$]+\.)+[\w$]+\(.*\)(?:\..*)?;?|[{}()\[\];,]+"
    r"|(?:import|from|use|using|include|require|package)\s+[\w.:*{}\"'/<>]+(?: import .*| as .*)?;?|(?:public|private|protected|def|func|fn|function|class|async|export|pub)\b.*[({:;].*)"
)
_BECOMES_CODE = re.compile(r".*[;{}]\s*$|.*\)\s*$|.*=.*|(?:return|break|continue|pass|throw|raise)\b.*|else:?")

#: Words that a rewording of a name adds to it.
_FILLER = frozenset(
    "a an the this that it its to of for in on from with by and or is are be will was does do did method function func fn class routine procedure helper utility operation"
    " implementation constructor ctor property field getter setter wrapper handler simple simply just here used which"
    " methode funktion fonction méthode función método der die das le la les el los las un une una ein eine diese dieser cette este esta".split()
)
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=\D)(?=\d)|(?<=\d)(?=\D)")


def _body(doc: str) -> list[str]:
    """The lines of a docstring without comment marks."""
    text = doc.replace("\r\n", "\n").replace("\r", "\n").replace("﻿", "").replace("​", "")
    text = _CLOSE.sub("", _OPEN.sub("", text.strip()))
    lines = [_LINE.sub("", _CLOSE.sub("", _OPEN.sub("", line))) if line.strip() != "***" else line for line in text.split("\n")]
    filled = [x for x in lines if x.strip()]
    if filled and len(filled) > 1 and all(_HASH.match(x) for x in filled):
        lines = [_HASH.sub("", x) for x in lines]
    return lines


def _untagged(lines: list[str]) -> list[str]:
    """The lines without tagged parts: a part ends at a blank line after its text, at the next tag, or where indentation falls back."""
    text = _UNDERLINED.sub(lambda m: m[0].split("\n")[0].strip() + ":", "\n".join(lines))
    kept: list[str] = []
    part, indent, filled = "", 0, False
    for line in text.split("\n"):
        bare, here = line.strip(), len(line) - len(line.lstrip())
        if _TAGGED.match(line) or _FIELD.match(line):
            part, filled = "tag", True
            continue
        if _SECTION.match(line) or _HEADING.match(line):
            part, indent, filled = "heading" if _HEADING.match(line) else "section", here, False
            continue
        if _DEPRECATED.match(line):
            part, filled = "tag", True
            continue
        if part == "tag":
            if bare and not _POINTER.fullmatch(bare):
                continue
            part = ""
        elif part == "section":
            if not bare or here > indent:
                continue
            part = ""
        elif part == "heading":
            if re.match(r"[ \t]*(?:[*\-+]|\d+[.)])[ \t]", line) or (bare and not filled) or (bare and here > indent + 1):
                filled = True
                continue
            if not bare:
                continue
            part = ""
        kept.append(line)
    return kept


def describe(doc: str | None) -> str:
    """The description in a docstring: no comment marks, markup or tagged parts; '' if nothing is left."""
    if not doc or not doc.strip():
        return ""
    text = "\n".join(_untagged(_XML_PART.sub("", "\n".join(_body(doc))).split("\n")))
    text = html.unescape(_MARKUP.sub(" ", _INLINE.sub(r"\1", text)))
    text = re.sub(r"\*\*([^*\n]+)\*\*|__([^_\n]+)__", lambda m: m[1] or m[2], text)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _stem(word: str) -> str:
    w = word.lower()
    for ending, least in (("ing", 5), ("ied", 4), ("ies", 4), ("ed", 4), ("es", 4), ("s", 4), ("d", 99)):
        if w.endswith(ending) and len(w) >= least and not w.endswith("ss"):
            w = w[: -len(ending)] + ("y" if ending in ("ies", "ied") else "")
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "sle":
        w = w[:-1]
    return w.rstrip("e") if len(w) > 3 else w


def _stems(text: str) -> list[str]:
    return [_stem(w) for x in _WORDS.findall(text) for w in _HUMPS.split(x) if w]


def _rewords(text: str, name: set[str]) -> bool:
    """True if text has no word but those of the name, in any form, and filler."""
    words = [w for x in _WORDS.findall(text) for w in _HUMPS.split(x) if w]
    return bool(words) and all(w.lower() in _FILLER or _stem(w) in name for w in words)


def _says_nothing(unit: str, name: set[str]) -> bool:
    u = unit.strip().strip("`").strip()
    u = re.sub(r"^(?:[-*+•]|\d+[.)])\s+", "", u)
    if not re.search(r"\w", u) or re.fullmatch(r"(.)\1*|[\W_]+", u):
        return True
    bare = u.rstrip(".!。 ")
    for pattern in (_PLACEHOLDER, _POINTER, _DIRECTIVE, _LICENCE):
        if pattern.fullmatch(bare) or pattern.fullmatch(u):
            return True
    if _CODE.fullmatch(u) and _BECOMES_CODE.fullmatch(u):
        return True
    return _rewords(re.sub(r"\(.*\)\s*$", "", u) if re.match(r"[\w.:]+\(", u) else u, name)


def trivial(description: str, name: str | None) -> bool:
    """True if a description is empty or every line of it says nothing beyond the name."""
    stems = set(_stems(name or ""))
    for line in description.split("\n"):
        if line.strip() and not _says_nothing(line, stems):
            for unit in re.split(r"(?<=[.!?。])\s+", line):
                if unit.strip() and not _says_nothing(unit, stems):
                    return False
    return True


def _described(doc: str, name: str) -> Column:
    def run(docs: pd.Series, names: pd.Series) -> pd.DataFrame:
        texts = [describe(d) for d in docs]
        return pd.DataFrame({"description": texts, "own": [not trivial(t, n) for t, n in zip(texts, names)]})

    run.__annotations__ = {"docs": pd.Series, "names": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "description string, own boolean")(doc, name)


def base_links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, spelling, base_id, how, n_choices) of every extends or implements edge that a class holds.

    A base is found by its id, else by its name: in the file of the class, else
    in its repository (the first part of the path), else anywhere; how says
    where. Where several classes have the name at the nearest of these, there
    is no base, how is 'ambiguous' and n_choices their number; a base that
    nothing is called is 'unknown'. An edge of a file's own code is its class's
    if the file has one class only; else it is 'ambiguous' too, with no class_id
    and the file's classes as choices, and 'unknown' if the file has none.
    """
    classes = symbols.where(F.col("kind").isin(*CLASS_LIKE, "enum")).select("id", "name", "file_path", F.split("file_path", "/")[0].alias("repo"))
    classes = checkpoint(classes)
    links = edges.where("kind in ('extends', 'implements') and to_id is not null").select(F.col("from_id").alias("holder"), F.col("to_id").alias("spelling")).distinct()
    of_file = F.col("holder").endswith("::__module__::class")
    in_class = links.where(~of_file).join(classes.select(F.col("id").alias("holder"), F.col("id").alias("class_id"), "file_path", "repo"), "holder")
    one = classes.groupBy("file_path").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"), F.min("repo").alias("repo"))
    loose = links.where(of_file).withColumn("file_path", F.expr("left(holder, length(holder) - 19)")).join(one, "file_path", "left")
    in_file = loose.where("_n = 1").select("holder", "spelling", F.col("_id").alias("class_id"), "file_path", "repo")
    held = in_class.select("class_id", "spelling", "file_path", "repo").unionByName(in_file.drop("holder")).distinct()
    bare = F.regexp_replace("spelling", r"[<\[(].*$", "")
    held = checkpoint(held.withColumn("name", F.substring_index(F.substring_index(bare, "::", -1), ".", -1)))

    def named(keys: list[str], as_: str) -> DataFrame:
        return classes.groupBy(*keys).agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).alias(as_))

    known = held.join(classes.select(F.col("id").alias("spelling"), F.lit(True).alias("_known")), "spelling", "left")
    known = known.join(named(["name", "file_path"], "_file"), ["name", "file_path"], "left").join(named(["name", "repo"], "_repo"), ["name", "repo"], "left")
    found = left_join_skewed(checkpoint(known), named(["name"], "_any"), "name")
    nearest = F.coalesce("_file", "_repo", "_any")
    where_ = F.when(F.col("_file").isNotNull(), "file").when(F.col("_repo").isNotNull(), "repository").otherwise("anywhere")
    base = F.when(F.col("_known"), F.col("spelling")).when(nearest["n"] == 1, nearest["id"])
    how = F.when(F.col("_known"), "id").when(nearest.isNull(), "unknown").when(nearest["n"] > 1, "ambiguous").otherwise(where_)
    out = found.select("class_id", "spelling", base.alias("base_id"), how.alias("how"), F.when(F.col("_known"), F.lit(1)).otherwise(F.coalesce(nearest["n"], F.lit(0))).cast("long").alias("n_choices"))
    lost = loose.where("_n is null or _n > 1").select(
        F.lit(None).cast("string").alias("class_id"), "spelling", F.lit(None).cast("string").alias("base_id"),
        F.when(F.col("_n") > 1, "ambiguous").otherwise("unknown").alias("how"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_choices"),
    )
    return out.unionByName(lost)


def base_classes(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(class_id, base_id): the links of base_links that lead to one other class."""
    return base_links(symbols, edges).where("base_id is not null and base_id <> class_id").select("class_id", "base_id").distinct()


def documented_functions(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Code-description pairs: id, language, signature, description, source ('own' or 'inherited'), described_in, level.

    Each current symbol of kind function or method with a non-blank signature
    gives at most one row. A description that is empty or trivial is replaced
    by that of the method of the same name in the nearest class up the
    hierarchy that has one (level says how far; of several as near, the
    smallest id); functions that find none are dropped. Hierarchies may be
    cyclic: no class is visited twice for the same method. A base that several
    classes could be is none (base_links reports it).
    """
    ship_package(symbols.sparkSession)
    current = checkpoint(current_symbols(symbols, ["name", "kind", "file_path", "signature", "docstring", "parent_id", "language"]))
    functions = current.where(F.col("kind").isin("function", "method") & F.col("signature").rlike(r"[^\s\p{Z}]"))
    told = functions.withColumn("_d", _described("docstring", "name")).select(
        "id", "name", "parent_id", "language", "signature", "_d.description", "_d.own"
    )
    told = checkpoint(told)
    bases = checkpoint(base_classes(current, edges))
    # A method without signature is no pair of its own, but may describe those that override it.
    silent = current.where(F.col("kind").isin("function", "method") & ~F.coalesce(F.col("signature").rlike(r"[^\s\p{Z}]"), F.lit(False)))
    silent = silent.withColumn("_d", _described("docstring", "name")).where("_d.own").select("id", "name", "parent_id", "_d.description")
    known = told.where("own").select("id", "name", "parent_id", "description").unionByName(silent).where("parent_id <> ''")
    # Only what a class has that is someone's base can be inherited.
    source = known.withColumnRenamed("parent_id", "at").join(bases.select(F.col("base_id").alias("at")).distinct(), "at", "left_semi")
    source = checkpoint(source.groupBy("at", "name").agg(F.min(F.struct("id", "description")).alias("found")))
    up = bases.select(F.col("class_id").alias("at"), F.col("base_id").alias("_up"))
    # Only methods that some documented method is called like, of classes that have a base, can find anything.
    open_ = told.where("not own and parent_id <> ''").select("id", "name", F.col("parent_id").alias("at"))
    open_ = open_.join(source.select("name").distinct(), "name", "left_semi")
    open_ = checkpoint(open_.join(bases.select(F.col("class_id").alias("at")).distinct(), "at", "left_semi").select("id", "name", "at"))
    seen, resolved, level = open_, None, 0
    while open_.limit(1).count():
        level += 1
        climbed = open_.join(up, "at").select("id", "name", F.col("_up").alias("at")).distinct()
        climbed = checkpoint(climbed.join(seen, ["id", "name", "at"], "left_anti").join(source, ["at", "name"], "left"))
        here = climbed.where("found is not null").groupBy("id").agg(F.min("found").alias("found")).withColumn("level", F.lit(level))
        resolved = here if resolved is None else resolved.unionByName(here)
        open_ = checkpoint(climbed.select("id", "name", "at").join(here.select("id"), "id", "left_anti"))
        seen = seen.unionByName(open_)
    columns = ["id", "language", "signature"]
    own = told.where("own").select(*columns, "description", F.lit("own").alias("source"), F.col("id").alias("described_in"), F.lit(0).alias("level"))
    if resolved is None:
        return own
    taken = told.where("not own").join(resolved, "id").select(
        *columns, F.col("found.description").alias("description"), F.lit("inherited").alias("source"), F.col("found.id").alias("described_in"), "level"
    )
    return own.unionByName(taken)
