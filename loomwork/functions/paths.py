"""Path, language and identifier functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: languages by file extension, and other names of languages
LANGUAGES = {
    "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "py": "python", "sh": "bash", "bash": "bash", "zsh": "bash", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "lean": "lean", "tla": "tla", "sol": "solidity",
}


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def extension(path: Column) -> Column:
    """Lower-case extension of the last path part, null if it has none; a leading dot doesn't begin one."""
    found = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(found != "", found)


def _known(ext: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)


def language(name: Column) -> Column:
    """The language that a user names by an extension or an alias, in any case; the name itself if it is unknown."""
    name = F.lower(F.trim(name))
    return F.coalesce(_known(name), name)


def path_language(path: Column) -> Column:
    """The language of a file by its extension, null if that is unknown."""
    return _known(extension(path))


def slug(identifier: Column) -> Column:
    """A file name for an id; changed ids get eight digits of their hash, so that they stay apart."""
    plain = F.regexp_replace(identifier, r"[^A-Za-z0-9._-]", "_")
    return F.when(plain == identifier, F.concat(plain, F.lit(".yaml"))).otherwise(F.concat(plain, F.lit("-"), F.substring(F.sha2(identifier, 256), 1, 8), F.lit(".yaml")))


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: * and ? stop at slashes, ** doesn't, {a,b} and [a-z] as usual."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", end
        else:
            out += "\\" + c if not c.isalnum() and c not in "/_-" else c
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found


def file_target(target: Column) -> Column:
    """(path, line_start, line_end, watch) of file://path#L1-L2, or of a bare path; null for other schemes.

    A fragment that isn't lines is left out.
    """
    bare = F.regexp_replace(target, "^file://", "")
    path = F.regexp_extract(bare, r"^([^#]*)", 1)
    first, last = (F.regexp_extract(bare, r"^[^#]*#L(\d+)(?:-L*(\d+))?$", i) for i in (1, 2))
    start = F.try_to_number(first, F.lit("999999999")).cast("int")
    end = F.coalesce(F.try_to_number(last, F.lit("999999999")).cast("int"), start)
    here = F.struct(normalize_path(path).alias("path"), start.alias("line_start"), end.alias("line_end"), F.when(start.isNull(), "file").otherwise("range").alias("watch"))
    return F.when((path != "") & ~bare.contains("://"), here)


def typed_scalar(text: Column) -> Column:
    """The kind of an annotation's literal: null, boolean, integer, number or string."""
    low = F.lower(text)
    number = text.try_cast("double")
    return (
        F.when(low == "null", "null").when(low.isin("true", "false"), "boolean").when(text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull(), "integer")
        .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & number.isNotNull(), "number").otherwise("string")
    )
