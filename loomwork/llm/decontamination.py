"""Benchmark decontamination by template canonicalisation, with built-in functions only.

Texts and items are turned into templates: numbers, units after numbers and names (runs of capitalised words, as one) become
typed placeholders, everything else is lower-cased and stripped of punctuation.  Windows of eight template tokens (all
tokens of a shorter item) are hashed and joined with the windows of the items; a text holds an item if it has at least
half of the item's windows.  The values behind the placeholders of common windows must be consistent: equal values of the
item stand for equal values of the text and different ones for different ones.  So the same question with other names
and numbers is caught, and a text that merely has the same shape is not.

What is a name depends on case, so windows are joined by their plain tokens as well: a passage taken word for word is found in
whatever case, line breaks and sentence it stands.

There are two steps.  The first looks in all texts for any window of any item: hashes of windows are combined from those of
their halves, so a text costs a few passes over arrays of longs, and only a text's number goes on.  The second looks
at the texts found, a small part, in detail.

Values are compared inside common windows alone, so words may be put in or left out and the text may go on differently.  Common
windows whose shifts lie close together make a copy of the item; each copy is judged by itself, and the windows of all
consistent copies count.  A placeholder that could stand for two of the text is not compared, nor is a capitalised word
that begins a sentence, unless it is a name elsewhere in the item.

Windows with fewer than three literal tokens say too little and are left out.  The items' windows are broadcast if they are
few, which is checked; otherwise the join shuffles.

An item that has no telling window is looked for by windows of its plain tokens, without placeholders; one of fewer than
three tokens, which would be found in any text that merely uses the word, by texts that consist of these tokens.

Defined cases: a null or empty text holds nothing, and such an item is never found; all texts of an item_id are searched,
also of a null one, and the best counts; rows are told apart by id and text; other columns, whatever their names, are
not looked at; texts of any length are searched whole, in their own row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import forget, settle, table, text_of

WINDOW, LEAST_LITERALS, LEAST_TOKENS, COVERAGE = 8, 3, 3, 0.5
#: Windows of all items, and texts found by the first step, up to this number are broadcast (two longs each at most).
BROADCAST_ROWS = 500_000
# fixed values: units of measure, as they follow a number
UNITS = "km cm mm m kg mg g t lb lbs oz l ml cl s ms sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years mile miles foot feet ft inch inches in yard yards pound pounds ounce ounces gallon gallons litre litres liter liters metre metres meter meters gram grams degree degrees percent dollar dollars euro euros cent cents mph kmh hz khz mhz ghz kb mb gb tb w kw v a"
#: Marks before a name, a number, a unit and a further word of a name; what joins the words of a value.
_NAME, _NUMBER, _UNIT, _MORE, _RUN = "\x01", "\x02", "\x03", "\x04", "\x1f"
_MARKS = _NAME + _NUMBER + _UNIT + _MORE
_BLANK = "\t\n\x0b\x0c\r"
_W = r"\p{L}\p{M}\p{N}'’-"


def with_tokens(df: DataFrame, text: Column, name: str = "tokens") -> DataFrame:
    """Adds the words of a text in lower case without punctuation; names, numbers and units begin with their marks.

    Each step is a column of its own, so that no regular expression runs twice.
    """
    s = F.translate(text, _MARKS + _BLANK, " " * len(_MARKS + _BLANK))
    s = F.regexp_replace(s, rf"(?=\p{{Lu}})(?<![^ \"'(\[«“„‘¿¡*_-])[{_W}]+", _NAME + "$0")
    s = F.lower(F.regexp_replace(s, rf"(\x01[{_W}]* +)(?=\x01)", "$1" + _MORE))
    number = F.regexp_replace("_s", r"(?=[0-9])(?<![\p{L}\p{N}.,\x01])[0-9]+(?:[.,:/][0-9]+)*", _NUMBER + "$0")
    unit = F.regexp_replace(number, rf"(?<=[0-9])( *)({'|'.join(UNITS.split())}|[%€$£°])(?![\p{{L}}\p{{N}}])", "$1" + _UNIT + "$2")
    bare = F.regexp_replace("_n", r"[^\p{L}\p{M}\p{N}\x01-\x04 %€$£°]+|(?<!\x03)[%€$£°]", "")
    df = df.withColumn("_s", s).withColumn("_n", F.when(F.col("_s").rlike("[0-9]"), unit).otherwise(F.col("_s")))
    return df.withColumn(name, F.array_remove(F.split(bare, " "), "")).drop("_s", "_n")


def _canonical(x: Column) -> Column:
    number = F.when(F.contains(x, F.lit(_UNIT)), _NUMBER + _UNIT).otherwise(_NUMBER)
    return F.when(x >= "\x05", x).when(x.startswith(_NAME), _NAME).when(x.startswith(_NUMBER), number).otherwise(_UNIT)


def _bare(x: Column) -> Column:
    return F.when(x >= "\x05", x).otherwise(F.translate(x, _MARKS, ""))


def template(tokens: Column) -> Column:
    """The template's tokens: of a marked token its marks only, further words of a name left out."""
    return F.transform(F.filter(tokens, lambda x: ~x.startswith(_MORE)), _canonical)


def plain(tokens: Column) -> Column:
    """The tokens without marks."""
    return F.transform(tokens, _bare)


def is_slot(x: Column) -> Column:
    return x < "\x05"


def starts(tokens: Column) -> Column:
    """For each template token the place (from 1) of its first word."""
    return F.filter(F.transform(tokens, lambda x, i: F.when(~x.startswith(_MORE), i + 1)), lambda x: x.isNotNull())


def template_hashes(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda x: ~x.startswith(_MORE)), lambda x: F.xxhash64(_canonical(x)))


def plain_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(_bare(x)))


def with_windows(df: DataFrame, hashes: Column, sizes: list[int], prefix: str) -> DataFrame:
    """Adds <prefix><size>: for each of the tokens' hashes the hash of the window of so many tokens that starts there.

    A window is hashed from its parts of 4, 2 and 1 tokens, so a size takes one or two steps for each token whatever it is.
    Windows that would run past the end have hashes that no whole window has.
    """
    beside = lambda a, b, by: F.zip_with(F.col(a), F.slice(F.col(b), by + 1, F.size(F.col(b))), lambda x, y: F.xxhash64(x, y))
    made, n = {1: f"{prefix}1"}, 1
    df = df.withColumn(made[1], hashes)
    while 2 * n <= max(sizes, default=1):
        made[2 * n] = f"{prefix}{2 * n}"
        df = df.withColumn(made[2 * n], beside(made[n], made[n], n))
        n *= 2
    for size in sizes:
        if size not in made:
            parts = [p for p in (4, 2, 1) if size & p]
            at, name = parts[0], made[parts[0]]
            for p in parts[1:]:
                new = f"{prefix}{at + p}" if at + p == size else f"{prefix}{size}_{at + p}"
                df = df.withColumn(new, beside(name, made[p], at))
                at, name = at + p, new
            made[size] = name
    return df.drop(*[c for n, c in made.items() if n not in sizes], *[c for c in df.columns if c.startswith(f"{prefix}") and "_" in c[len(prefix) :] and c[len(prefix) : len(prefix) + 1].isdigit()])


def by_size(prefix: str, size: Column) -> Column:
    return F.coalesce(*[F.when(size == n, F.col(f"{prefix}{n}")) for n in range(1, WINDOW + 1)])


def whole(tokens: Column) -> Column:
    return F.xxhash64(F.lit("whole"), tokens)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens, names) of each distinct text of each item_id; names are the words of names within sentences."""
    rows = benchmark.select("item_id", text_of().alias("text")).distinct()
    names = F.regexp_extract_all("text", F.lit(rf"(?<=[\p{{L}}\p{{N}},;]\s)\p{{Lu}}[{_W}]*"), F.lit(0))
    names = F.transform(names, lambda x: F.regexp_replace(F.lower(x), r"['’-]", ""))
    rows = with_tokens(rows.withColumn("names", F.array_distinct(names)), F.col("text"))
    return rows.where(F.size("tokens") > 0).select(F.xxhash64("item_id", "text").alias("item"), "item_id", "tokens", "names")


def slots_of(t: Column, p: Column, at: Column) -> Column:
    """The placeholders of a row: place, number in the template, and value (its type and its words)."""
    def row(x: Column, i: Column) -> Column:
        words = F.slice(p, F.get(at, i), F.coalesce(F.get(at, i + 1), F.size(p) + 1) - F.get(at, i))
        return F.when(is_slot(x), F.struct(F.get(at, i).alias("at"), (i + 1).alias("i"), F.concat(F.substring(x, 1, 1), F.array_join(words, _RUN)).alias("value")))

    return F.filter(F.transform(t, row), lambda s: s.isNotNull())


def item_windows(items: DataFrame) -> DataFrame:
    """(item, at, i, size, h, keys, slots, n, length) of each item's telling windows, or its plain ones if it has none.

    ``keys`` are a window's typed and its plain hash, ``n`` the number of the item's different windows, ``slots`` the
    placeholders that are compared.
    """
    tokens, sizes = F.col("tokens"), list(range(1, WINDOW + 1))
    rows = items.select("item", "names", "tokens", template(tokens).alias("t"), plain(tokens).alias("p"), starts(tokens).alias("s"))
    rows = with_windows(with_windows(rows, template_hashes(tokens), sizes, "t"), plain_hashes(tokens), sizes, "p").drop("tokens")
    rows = settle(rows, "itemarrays")  # else the optimiser would move these arrays into the functions that look up in them
    words = lambda x: F.split(F.substring(x, 2, 1 << 30), _RUN)
    told = lambda x: ~x["value"].startswith(_NAME) | F.arrays_overlap(words(x["value"]), F.col("names"))
    rows = rows.withColumn("slots", F.filter(slots_of(F.col("t"), F.col("p"), F.col("s")), told))
    rows = rows.withColumns({"nt": F.least(F.size("t"), F.lit(WINDOW)), "np": F.least(F.size("p"), F.lit(WINDOW)), "length": F.size("p")})
    rows = rows.withColumns({"ht": by_size("t", F.col("nt")), "hp": by_size("p", F.col("np"))})
    literals = lambda i: F.size(F.filter(F.slice("t", i, F.col("nt")), lambda x: ~is_slot(x)))
    typed = F.transform(F.sequence(F.lit(1), F.size("t") - F.col("nt") + 1), lambda i: F.struct(i.alias("i"), F.get("s", i - 1).alias("at"), F.col("nt").alias("size"), F.get("ht", i - 1).alias("h"), (literals(i) >= LEAST_LITERALS).alias("telling")))
    telling = F.filter(typed, lambda x: x["telling"])
    enough = F.col("length") >= LEAST_TOKENS
    key = lambda at: F.when(enough, F.get("hp", at - 1)).otherwise(whole(F.col("p")))
    with_plain = F.transform(telling, lambda x: F.struct(x["i"].alias("i"), x["at"].alias("at"), x["size"].alias("size"), x["h"].alias("h"), F.array(x["h"], key(x["at"])).alias("keys")))
    last = F.when(enough, F.size("p") - F.col("np") + 1).otherwise(F.lit(1))
    only = F.transform(F.sequence(F.lit(1), last), lambda at: F.struct(F.lit(0).alias("i"), at.alias("at"), F.col("np").alias("size"), key(at).alias("h"), F.array(key(at)).alias("keys")))
    rows = rows.withColumn("windows", F.when(enough & (F.size(telling) > 0), with_plain).otherwise(only))
    n = F.size(F.array_distinct(F.col("windows.h")))
    return rows.select("item", "slots", "np", "length", n.alias("n"), F.explode("windows").alias("x")).select("item", "slots", "np", "length", "n", "x.*")


def keys_of(rows: DataFrame, typed: list[int], words: list[int]) -> DataFrame:
    """Adds tokens, t<size> and p<size>, and ``short``: the hash of a text of one or two words; drops text."""
    rows = with_tokens(rows, F.col("text")).drop("text")
    tokens = F.col("tokens")
    rows = rows.withColumn("short", F.when(F.size(tokens).between(1, LEAST_TOKENS - 1), whole(plain(tokens))))
    return with_windows(with_windows(rows, template_hashes(tokens), typed, "t"), plain_hashes(tokens), words, "p")


def candidates(rows: DataFrame, keys: DataFrame, typed: list[int], words: list[int], few: bool) -> DataFrame:
    """(row_hash) of the texts that have a window of any item."""
    rows = keys_of(rows, typed, words)
    short = F.when(F.col("short").isNotNull(), F.array("short")).otherwise(F.array().cast("array<bigint>"))
    windows = F.concat(short, *[F.col(f"t{n}") for n in typed], *[F.col(f"p{n}") for n in words])
    rows = rows.select("row_hash", F.explode(F.array_distinct(windows)).alias("key"))
    return rows.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("row_hash").distinct()


def common_windows(rows: DataFrame, windows: DataFrame, typed: list[int], words: list[int], few: bool) -> DataFrame:
    """(row_hash, item, at, doc_at, h, n, length, pairs) of each window that a text and an item have in common.

    ``pairs`` are the compared placeholders inside it: place and value in the item and in the text.
    """
    tokens = F.col("tokens")
    rows = keys_of(rows, typed, words).select("*", starts(tokens).alias("s"), template(tokens).alias("t"), plain(tokens).alias("p")).drop("tokens")
    rows = settle(rows, "arrays")
    rows = settle(rows.withColumn("own", slots_of(F.col("t"), F.col("p"), F.col("s"))).drop("t", "p"), "slots")
    place = lambda i, at, size, key: F.struct(i.alias("j"), at.alias("doc_at"), size.alias("own_size"), key.alias("key"))
    none = F.array().cast("array<struct<j:int,doc_at:int,own_size:int,key:bigint>>")
    of_t = [F.transform(f"t{n}", partial(lambda n, h, j: place(j + 1, F.get("s", j), F.lit(n), h), n)) for n in typed]
    of_p = [F.transform(f"p{n}", partial(lambda n, h, j: place(F.lit(0), j + 1, F.lit(n), h), n)) for n in words]
    short = F.when(F.col("short").isNotNull(), F.array(place(F.lit(0), F.lit(1), F.lit(0), F.col("short")))).otherwise(none)
    placed = rows.select("row_hash", F.explode(F.concat(short, *of_t, *of_p)).alias("x")).select("row_hash", "x.*")
    asked = windows.select("item", "slots", "np", "length", "n", "i", "at", "h", F.explode(F.array_distinct("keys")).alias("key"))
    hits = placed.join(F.broadcast(asked) if few else asked, "key").join(rows.select("row_hash", "own"), "row_hash")
    inside = F.filter("own", lambda s: (s["i"] >= F.col("j")) & (s["i"] < F.col("j") + F.col("own_size")))
    hits = settle(hits.select("*", F.when((F.col("j") > 0) & (F.size("slots") > 0), inside).alias("within")).drop("own"), "common")
    # a template window has its placeholders in order; in a plain one each value stands for itself
    of_typed = F.transform("slots", lambda s: F.struct(s["at"].alias("at"), s["value"].alias("value"), F.get(F.filter("within", lambda o: o["i"] - F.col("j") == s["i"] - F.col("i")), F.lit(0)).alias("o")))
    of_typed = F.transform(F.filter(of_typed, lambda s: s["o"].isNotNull()), lambda s: F.struct(s["at"].alias("at"), s["value"].alias("value"), s["o"]["at"].alias("doc_at"), s["o"]["value"].alias("own")))
    there = lambda s: (s["at"] >= F.col("at")) & (s["at"] + F.size(F.split(s["value"], _RUN)) <= F.col("at") + F.col("np"))
    of_plain = F.transform(F.filter("slots", there), lambda s: F.struct(s["at"].alias("at"), s["value"].alias("value"), (s["at"] - F.col("at") + F.col("doc_at")).alias("doc_at"), s["value"].alias("own")))
    return hits.select("row_hash", "item", "at", "doc_at", "h", "n", "length", F.when(F.col("j") > 0, of_typed).otherwise(of_plain).alias("pairs"))


def copies(hits: DataFrame) -> DataFrame:
    """Adds copy, best: which copy of the item in the text a common window belongs to.

    A copy ends where the next shift is more than half an item away.  Windows that occur more than once in the item or the copy
    are aligned by the shift that most windows have; the others are not ``best``.
    """
    rows = hits.withColumn("shift", F.col("doc_at") - F.col("at"))
    pair = ["row_hash", "item"]
    ordered = Window.partitionBy(*pair).orderBy("shift", "at")
    far = (F.col("shift") - F.lag("shift").over(ordered)) * 2 > F.col("length")
    rows = rows.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("copy", F.sum("far").over(ordered))
    rows = rows.withColumn("votes", F.count("*").over(Window.partitionBy(*pair, "shift")))
    first = lambda at: F.row_number().over(Window.partitionBy(*pair, "copy", at).orderBy(F.desc("votes"), "shift")) == 1
    return rows.withColumn("best", first("at") & first("doc_at")).drop("length", "shift", "far", "votes")


def judged(found: DataFrame) -> DataFrame:
    """(row_hash, item, copy, slots, verbatim, consistent) of the copies with placeholders, those of two places left out."""
    rows = found.where("best").select("row_hash", "item", "copy", F.explode("pairs").alias("s")).select("row_hash", "item", "copy", "s.*").distinct()
    alone = lambda at: F.count("*").over(Window.partitionBy("row_hash", "item", "copy", at)) == 1
    rows = rows.withColumn("alone", alone("at") & alone("doc_at")).where("alone")
    sides = rows.groupBy("row_hash", "item", "copy").agg(F.size(F.collect_set("at")).alias("slots"), F.collect_set(F.struct("value", "own")).alias("v"), F.min(F.col("value") == F.col("own")).alias("verbatim"))
    one_to_one = (F.size(F.array_distinct("v.value")) == F.size("v")) & (F.size(F.array_distinct("v.own")) == F.size("v"))
    return sides.select("row_hash", "item", "copy", "slots", "verbatim", one_to_one.alias("consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, row_hash, item_id, coverage, slots, verbatim) for each text and item it holds.

    ``row_hash`` tells rows of one doc_id apart; ``slots`` counts the item's placeholders that were compared, in each copy;
    ``verbatim`` says whether all their values are the item's own.
    """
    spark = docs.sparkSession
    items = settle(items_of(benchmark), "items")
    windows = settle(item_windows(items), "windows")
    keys = settle(windows.select(F.explode("keys").alias("key")).distinct(), "keys")
    sizes = windows.agg(F.collect_set(F.when(F.col("i") > 0, F.col("size"))).alias("t"), F.collect_set(F.when(F.col("length") >= LEAST_TOKENS, F.col("np"))).alias("p")).first()
    typed, words, few = sorted(sizes["t"]), sorted(sizes["p"]), windows.count() <= BROADCAST_ROWS
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id"), text_of()).alias("row_hash"), text_of().alias("text"))
    found = settle(candidates(rows.select("row_hash", "text"), keys, typed, words, few), "found")
    picked = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    texts = settle(rows.join(picked, "row_hash", "left_semi"), "texts")
    hits = common_windows(texts.select("row_hash", "text").dropDuplicates(["row_hash"]), windows, typed, words, few)
    share = F.size(F.collect_set("h").over(Window.partitionBy("row_hash", "item"))) / F.col("n")
    hits = settle(hits.withColumn("share", share).where(F.col("share") >= coverage).drop("share"), "hits")
    of_copies = settle(copies(hits), "copies")
    kept = of_copies.groupBy("row_hash", "item", "n", "copy").agg(F.collect_set("h").alias("hs"))
    kept = kept.join(judged(of_copies), ["row_hash", "item", "copy"], "left").where("coalesce(consistent, true)")
    k = F.size(F.array_distinct(F.flatten(F.collect_list("hs"))))
    out = kept.groupBy("row_hash", "item").agg((k / F.first("n")).alias("coverage"), F.coalesce(F.sum("slots"), F.lit(0)).cast("long").alias("slots"), F.coalesce(F.min("verbatim"), F.lit(True)).alias("verbatim"))
    out = out.where(F.col("coverage") >= coverage).join(items.select("item", "item_id"), "item")
    out = out.groupBy("row_hash", "item_id").agg(F.max(F.struct("coverage", "verbatim", "slots")).alias("x"))
    ids = texts.select("doc_id", "row_hash").distinct()
    out = settle(out.join(ids, "row_hash").select("doc_id", "row_hash", "item_id", "x.coverage", "x.slots", "x.verbatim"), "contaminated")
    forget(spark, items, windows, keys, found, texts, hits, of_copies)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    found = contaminated(docs, benchmark, coverage).select(F.col("row_hash").alias("_h")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(F.col("doc_id"), text_of()).alias("_h"))
    return rows.join(found, "_h", "left_anti").select("_row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, and which."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "slots", "verbatim").distinct()
