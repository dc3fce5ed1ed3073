"""Column expressions for paths, identifiers, spellings and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "cs": "csharp", "py": "python", "go": "go", "java": "java", "rs": "rust"}
#: Folders of other people's code.
VENDOR = ("node_modules", "vendor", "target", ".cargo", "venv", "site-packages", ".m2", "third_party")
#: Names too general to make a symbol important or a query specific, by language.
STOPWORDS = {
    "typescript": ("constructor", "toString", "valueOf", "render", "default"),
    "csharp": ("ToString", "GetHashCode", "Equals", "Dispose", "GetType", "Main"),
    "python": ("__init__", "__str__", "__repr__", "__eq__", "__hash__", "__len__", "__iter__", "__next__"),
    "rust": ("new", "default", "from", "into", "run", "build", "try_from", "fmt", "clone", "drop"),
    "go": ("String", "Error", "Close", "Read", "Write", "New", "Init", "Run"),
    "java": ("toString", "hashCode", "equals", "get", "set", "of", "main", "run", "close"),
}
#: What the steps of an impact are called, from the first on; further ones share the last name.
IMPACT_LABELS = ("Direct callers", "Second-degree", "Third-degree", "Further impact")
#: What an edge kind is called in reports.
KIND_WORDS = {
    "calls": "called", "imports": "imported", "extends": "extended", "implements": "implemented",
    "instantiates": "instantiated", "references": "referenced", "references_type": "used as type",
}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def language_of(path: Column) -> Column:
    """Language of a file by its extension; null for any other."""
    ext, out = extension(path), F.lit(None).cast("string")
    for e, language in LANGUAGES.items():
        out = F.when(ext == e, F.lit(language)).otherwise(out)
    return out


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike(r"(^|/)tests?/") | low.rlike(r"[._](test|spec)\.")


def is_vendor_path(path: Column, patterns: tuple[str, ...] = VENDOR) -> Column:
    """True if a whole component of the path is one of the patterns."""
    return F.arrays_overlap(F.split(slashes(path), "/"), F.array(*[F.lit(p) for p in patterns]))


def entry_group(path: Column) -> Column:
    """Group of an entry point by words in its path (fixed values; the first that fits)."""
    low = F.lower(path)
    return (
        F.when(low.contains("controller"), "API Controllers")
        .when(low.contains("worker") | low.contains("job"), "Background Workers")
        .when(low.contains("handler") | low.contains("listener"), "Event Handlers")
        .otherwise("Other")
    )


def directory(path: Column) -> Column:
    """First folder below a leading src/, with a slash; '(root)/' for files beside it."""
    rest = F.regexp_replace(path, "^src/", "")
    return F.concat(F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise(F.lit("(root)")), F.lit("/"))


def line_range(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def name_in_id(id_: Column) -> Column:
    """Second part of an id, else the id itself."""
    part = F.try_element_at(F.split(id_, "::"), F.lit(2))
    return F.when(part != "", part).otherwise(id_)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def camel_split(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")


def snake_split(name: Column) -> Column:
    return F.translate(name, "_", " ")


def tails(spelling: Column) -> Column:
    """Every name that a spelling refers to: itself, and what follows each '::' and each '.'."""
    def after(mark: str) -> Column:
        parts = F.split(spelling, mark.replace(".", r"\."))
        n = F.size(parts)
        return F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, n), mark))

    both = F.concat(F.array(spelling), after("::"), after("."))
    return F.array_distinct(F.filter(both, lambda t: t != ""))


def member_tail(spelling: Column) -> Column:
    """What follows the last '.', null where there is none."""
    return F.when(spelling.contains("."), F.substring_index(spelling, ".", -1))


def kind_words(kind: Column) -> Column:
    out = kind
    for k, words in KIND_WORDS.items():
        out = F.when(kind == k, F.lit(words)).otherwise(out)
    return out


def modifiers(metadata: Column) -> Column:
    """Access (unless public) and the set flags of a symbol's metadata, in the order they are shown."""
    v = F.try_parse_json(metadata)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    access = F.coalesce(get("access", "string"), get("visibility", "string"))
    flags = [F.when(get(f"is_{w}", "boolean"), F.lit(w)) for w in ("async", "static", "abstract", "virtual", "override")]
    return F.array_compact(F.array(F.when((access != "public") & (access != ""), access), *flags))


def method_line(signature: Column, mods: Column) -> Column:
    """The signature with those modifiers before it that it doesn't contain."""
    return F.concat_ws(" ", F.filter(mods, lambda m: ~F.contains(signature, m)), signature)


def relative_time(seconds: Column) -> Column:
    unit = lambda n, word: F.concat((seconds / n).cast("long").cast("string"), F.lit(f" {word} ago"))
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, unit(60, "min"))
        .when(seconds < 86400, unit(3600, "h"))
        .otherwise(unit(86400, "d"))
    )


def is_general_name(name: Column, language: Column) -> Column:
    """True if a name is a stopword of its language; case counts."""
    return F.coalesce(F.array_contains(F.create_map(*[x for k, v in STOPWORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[language], name), F.lit(False))


def impact_label(depth: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, IMPACT_LABELS)), F.least(depth.cast("int"), F.lit(len(IMPACT_LABELS))))


def parent_in_id(id_: Column) -> Column:
    """Second part of an id from the end, as short ids without kind and line name their parent; null where there is none."""
    parts = F.split(id_, "::")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def looks_like_path(text: Column) -> Column:
    """True for what is rather a file than a symbol: it has a separator or ends like a source file."""
    return text.contains("/") | text.contains("\\") | text.rlike(r"\.(?:ts|tsx|js|jsx|cs|py|go|java|rs)$")


def enrichment(language: Column, metadata: Column) -> Column:
    """What a signature is shown with: '@name's of Java annotations and Python decorators, Go's receiver; else ''."""
    v = F.try_parse_json(metadata)
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    text = lambda x: F.try_variant_get(x, "$", "string")

    def marks(field: str) -> Column:
        named = F.filter(F.try_variant_get(v, f"$.{field}", "array<variant>"), lambda a: is_text(a) & (text(a) != ""))
        return F.array_join(F.transform(named, lambda a: F.concat(F.lit("@"), text(a))), " ")

    got = F.try_variant_get(v, "$.receiver", "variant")
    receiver = F.when(is_text(got), text(got))
    star = F.when(F.try_variant_get(v, "$.is_pointer_receiver", "boolean"), "*").otherwise("")
    go = F.when(receiver != "", F.concat(F.lit("("), F.lower(F.substring(receiver, 1, 1)), F.lit(" "), star, receiver, F.lit(")")))
    return F.coalesce(F.when(language == "java", marks("annotations")).when(language == "python", marks("decorators")).when(language == "go", go), F.lit(""))


def inferred_access(name: Column) -> Column:
    """Access of a Python name: '__x' without a dunder end is name_mangled, '_x' private, else public."""
    return F.when(name.startswith("__") & ~name.endswith("__"), "name_mangled").when(name.startswith("_"), "private").otherwise("public")
