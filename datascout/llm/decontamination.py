"""Benchmark decontamination by template canonicalisation (operator 8, native).

Texts become templates: case and punctuation go, and numbers (digits and words), units after numbers and names (capitalised words
inside a sentence) become typed slots.  Windows of template words are hash-joined with the benchmark's windows.  Where the windows that match
along a run of near places cover enough of an item, the slots they cover are compared: a text that is the item with other values gives each
value of the item one value of its own.  That is a leak; one that gives a value two is not.  Windows of plain words, of which
none is a slot, are joined as well: so copies in another case, and of items that are slots for the most part, are found too.

What counts of an item is what is its own: windows that items of other words hold as well (instructions, say) are evidence of none of them.
Items too short for that count only as a whole line or sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_side, stash

#: Words in a window; fewest words in it that are no slots; share of an item's own words that must match.
WINDOW, LITERALS, SHARE = 5, 2, 0.6
#: Words that must match at least, and that an item must have, to be found inside a sentence; shorter ones need so many words that are no slots.
SHORT, SHORT_LITERALS = 8, 3
#: Words that may be put in or left out between windows of one run.
DRIFT = 16
#: Most benchmark windows that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Fixed value: measures that count as units after a number.
UNITS = "mm|cm|m|km|in|ft|yd|mi|mg|g|kg|t|lb|lbs|oz|ml|cl|l|s|sec|min|h|hr|hrs|kb|mb|gb|w|kw|v|a|hz|pm|am|inch|inches|feet|foot|yards?|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|grams?|kilograms?|pounds?|ounces?|lit(?:er|re)s?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
#: Fixed value: number words that count as numbers.
NUMBER_WORDS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million"
#: Slots: private-use characters, so that no text word equals one but by intent.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
_SLOTS = f"{NAME}-{UNIT}"


def spaced(text: Column) -> Column:
    """The words of a text, one space between them; null: none.  Only gaps that aren't one space already are matched: matches are what costs."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*| [\x20\x09-\x0D]+", " "))


def template(words: Column) -> Column:
    """Template of a spaced text: as many words (some may become empty), so that places correspond."""
    x = F.regexp_replace(words, f"[{_SLOTS}]", "")
    # a cheap test comes first in each pattern, since it is tried at every place of the text
    x = F.regexp_replace(x, r"\p{Lu}(?<=[\p{L}\p{N},;:] \p{Lu})[\p{Ll}\p{M}]+(?![\p{L}\p{M}])", NAME)
    x = F.regexp_replace(x, r"\p{Nd}(?:[\p{Nd}.,:/]*\p{Nd})?", NUMBER)
    x = F.lower(x)
    x = F.regexp_replace(x, rf"(?=[efhmnst])(?<![\p{{L}}\p{{M}}])(?:{NUMBER_WORDS})(?![\p{{L}}\p{{M}}])", NUMBER)
    x = F.when(F.contains(x, F.lit(NUMBER)), F.regexp_replace(x, rf"(?=[a-z])(?<={NUMBER} ?)(?:{UNITS})(?![\p{{L}}\p{{M}}])", UNIT)).otherwise(x)
    return F.regexp_replace(x, rf"[^\p{{L}}\p{{M}}\p{{N}}{_SLOTS} ]+", "")


def plain(words: Column) -> Column:
    """A spaced text without case and signs, of as many words."""
    return F.regexp_replace(F.lower(words), r"[^\p{L}\p{M}\p{N} ]+", "")


def joined(x: Column) -> Column:
    """The words of a template or plain text that aren't empty, one space between them."""
    return F.trim(F.regexp_replace(x, "  +", " "))


def _is_slot(w: Column) -> Column:
    return w.rlike(f"[{_SLOTS}]")


def _windows(rows: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, at, h, more): place and hash of each window of rows (keys, line): words are hashed once, and a window is the hash of its words' hashes."""
    words = F.split("line", " ")
    shifted = lambda c, k: F.slice(c, k + 1, 1 << 30) if k else F.col(c)
    hashed = rows.select(*keys, *more, F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    each = hashed.select(*keys, *more, F.posexplode(F.arrays_zip(*[shifted("hashes", k).alias(f"w{k}") for k in range(WINDOW)])).alias("at", "w"))
    return each.where(F.col(f"w.w{WINDOW - 1}").isNotNull()).select(*keys, "at", F.xxhash64(*[f"w.w{k}" for k in range(WINDOW)]).alias("h"), *more)


def _literals(words: Column) -> Column:
    return F.regexp_count(words, F.lit(rf"(?<![^ ])[^ {_SLOTS}]+(?![^ ])"))


def item_lines(benchmark: DataFrame, of) -> DataFrame:
    """(item_id, raw, line, key, words): items that have a word; key: a hash of the line.  of: template or plain."""
    t = benchmark.select("item_id", spaced(F.col("text")).alias("raw"))
    t = t.withColumn("line", joined(of(F.col("raw")))).where("line <> ''")
    return t.withColumn("key", F.xxhash64("line")).withColumn("words", F.size(F.split("line", " ")))


def own_windows(items: DataFrame) -> DataFrame:
    """(h, key, spot, own, anchor, off): windows that count for the items of a line, and how many words of the line they cover.

    These are windows that no other line has; all, if a line has none of its own.  Windows of slots for the most part count nowhere.
    anchor: hash of the window's longest word, off: that word's place in the window; both follow from the window's words alone.
    """
    lines = items.where(F.col("words") >= SHORT).groupBy("key").agg(F.first("line").alias("line"))
    each = _windows(lines, ["key"], ("line",)).withColumn("w", F.array_join(F.slice(F.split("line", " "), F.col("at") + 1, WINDOW), " "))
    longest = F.array_max(F.transform(F.split("w", " "), lambda w, k: F.struct(F.length(w).alias("n"), w.alias("w"), k.alias("off"))))
    each = each.where(_literals(F.col("w")) >= LITERALS).withColumn("a", longest)
    each = each.select("key", F.col("at").alias("spot"), "h", F.xxhash64("a.w").alias("anchor"), F.col("a.off").alias("off"))
    held = each.groupBy(F.col("h").alias("of")).agg((F.count_distinct("key") == 1).alias("single"))
    each = each.join(held, F.col("h") == F.col("of")).drop("of")
    some = each.groupBy(F.col("key").alias("k")).agg(F.max("single").alias("some"))
    each = each.join(some, F.col("key") == F.col("k")).where(F.col("single") | ~F.col("some"))
    places = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("spot", F.col("spot") + WINDOW - 1)))))
    own = each.groupBy(F.col("key").alias("k2")).agg(places.alias("own"))
    return each.join(own, F.col("key") == F.col("k2")).select("h", "key", "spot", "own", "anchor", "off")


def _hits(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, rid, at, key, spot, own): places of rows (doc_id, rid, line) where a window of held starts.

    Where held is small, only windows around a word that is the anchor of one are hashed: that word stands at the same place in every
    copy of the window, so none is missed, and one place has one hit a window.  Otherwise all windows are dealt by their hash.
    """
    if held.count() > BROADCAST_WINDOWS:
        return _windows(rows, ["doc_id", "rid"]).withColumnRenamed("h", "mine").join(held, F.col("mine") == F.col("h"))
    words = rows.select("doc_id", "rid", F.split("line", " ").alias("line_words"))
    each = words.select("*", F.posexplode_outer("line_words").alias("p", "w"))  # outer: else the words are made once more, to test for any
    anchors = held.select(F.col("anchor").alias("of"), F.col("off").alias("mine_off")).distinct()
    some = each.join(F.broadcast(anchors), F.xxhash64("w") == F.col("of")).withColumn("at", F.col("p") - F.col("mine_off"))
    some = some.where((F.col("at") >= 0) & (F.col("at") + WINDOW <= F.size("line_words")))
    mine = F.xxhash64(*[F.xxhash64(F.get("line_words", F.col("at") + k)) for k in range(WINDOW)])  # as in _windows()
    some = some.select("doc_id", "rid", "at", "mine_off", mine.alias("mine"))
    return some.join(F.broadcast(held), (F.col("mine") == F.col("h")) & (F.col("mine_off") == F.col("off")))


def _found(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, rid, key, hits, covered, own): runs of windows (spot, at) of a row (doc_id, rid, line) that cover enough of a line."""
    held = stash(own_windows(items), "own_windows")  # written, so that the plan stays small
    hits = _hits(rows, held)
    run = F.floor((F.col("at") - F.col("spot")) / DRIFT)  # runs overlap, so that places within DRIFT of each other share one
    runs = hits.select("doc_id", "rid", "key", "own", "spot", "at", F.explode(F.array(run, run - 1)).alias("run"))
    runs = runs.groupBy("doc_id", "rid", "key", "run").agg(F.collect_set(F.struct("spot", "at")).alias("hits"), F.first("own").alias("own"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["spot"], h["spot"] + WINDOW - 1)))))
    runs = runs.withColumn("covered", covered)
    return runs.where((F.col("covered") >= F.ceil(SHARE * F.col("own"))) & (F.col("covered") >= F.least(F.lit(SHORT), F.col("own"))))


def _short(docs: DataFrame, items: DataFrame, of, literals: int) -> DataFrame:
    """(doc_id, rid, item_id, raw, theirs): lines and sentences of docs (doc_id, rid, text) that are all of a short item."""
    short = items.where((F.col("words") < SHORT) & (_literals(F.col("line")) >= literals)).select("item_id", F.col("raw").alias("theirs"), "key")
    parts = F.array_distinct(F.concat(F.split("text", r"[\n\r]+"), F.split("text", r"[.!?]+(?=[\x20\x09-\x0D]|$)|[\n\r]+")))
    parts = docs.select("doc_id", "rid", F.explode(parts).alias("part")).select("doc_id", "rid", spaced(F.col("part")).alias("raw"))
    parts = parts.where(F.size(F.split("raw", " ")) < 2 * SHORT)  # words of signs only don't count
    parts = parts.select("doc_id", "rid", "raw", F.xxhash64(joined(of(F.col("raw")))).alias("mine"))
    return parts.join(short, F.col("mine") == F.col("key")).select("doc_id", "rid", "item_id", "raw", "theirs")


_RESULT = "doc_id long, rid long, item_id long, n_covered int, n_own int, n_slots int, n_changed int"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, rid, item_id, n_covered, n_own, n_slots, n_changed, kind) of each row of docs that holds an item.

    n_own: words of the item that its own windows cover (all words of a short item), n_covered: those that match, SHARE of them or more.
    An item under SHORT words is found as a whole line or sentence only.  rid is a hash of the row's id and text: rows that repeat both give
    one result, rows that repeat the id only are judged each.  kind: 'copy' (no slot differs; found by its template or by its plain words) or
    'reparameterised'.  Null or empty texts match nothing; nor do items without words.  Items of slots for the most part are found by plain
    words only (n_slots is 0 then).  A null doc_id or item_id stays null in the result.
    """
    rid = F.xxhash64(F.col("doc_id"), F.col("text")).alias("rid")
    rows = docs.select("doc_id", rid, "text")
    every = docs.sparkSession.createDataFrame([], _RESULT)
    for of, literals in ((template, SHORT_LITERALS), (plain, 0)):
        items = stash(item_lines(benchmark, of), "item_lines")
        sizes = {r["long"] for r in items.select((F.col("words") >= SHORT).alias("long")).distinct().collect()}
        if True in sizes:
            lines = rows.select("doc_id", "rid", joined(of(spaced(F.col("text")))).alias("line"))
            found = stash(_found(lines, items), "runs")
            if of is template:
                every = every.unionByName(_consistent(found, rows, items))
            else:
                ids = items.select("item_id", "key")
                every = every.unionByName(found.join(ids, "key").select("doc_id", "rid", "item_id", F.col("covered").alias("n_covered"), F.col("own").alias("n_own"), F.lit(0).alias("n_slots"), F.lit(0).alias("n_changed")))
        if False in sizes:
            every = every.unionByName(_same(_short(rows, items, of, literals), of))
    order = F.struct("n_covered", -F.col("n_changed"), "n_slots", "n_own")
    best = F.max_by(F.struct("n_covered", "n_own", "n_slots", "n_changed"), order).alias("b")
    x = every.groupBy("doc_id", "rid", "item_id").agg(best).select("doc_id", "rid", "item_id", "b.*")
    return x.withColumn("kind", F.when(F.col("n_changed") == 0, "copy").otherwise("reparameterised"))


def _slots(words: Column, raw: Column) -> Column:
    """The raw words of a spaced text whose template words aren't empty, and whether these are slots."""
    both = F.arrays_zip(F.split(words, " ").alias("t"), F.split(raw, " ").alias("r"))
    return F.transform(F.filter(both, lambda x: x["t"] != ""), lambda x: F.struct(_is_slot(x["t"]).alias("slot"), F.lower(F.regexp_replace(x["r"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("value")))


def _judged(x: DataFrame, covered: Column, own: Column) -> DataFrame:
    """The rows whose pairs (i: word of the item, d: of the text) give each value in an item's slots one value in the text's."""
    both = F.filter("pairs", lambda p: p["i"]["slot"] & p["d"]["slot"])
    x = x.withColumn("values", F.array_distinct(F.transform(both, lambda p: F.struct(p["i"]["value"].alias("i"), p["d"]["value"].alias("d")))))
    one_each = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda p: p["i"])))
    changed = F.size(F.filter("values", lambda p: p["i"] != p["d"]))
    return x.where(one_each).select("doc_id", "rid", "item_id", covered.alias("n_covered"), own.alias("n_own"), F.size("values").alias("n_slots"), changed.alias("n_changed"))


def _same(found: DataFrame, of) -> DataFrame:
    """Of rows (doc_id, rid, item_id, raw, theirs) of equal lines those with consistent slots; plain words have none."""
    mine, theirs = _slots(of(F.col("raw")), F.col("raw")), _slots(of(F.col("theirs")), F.col("theirs"))
    x = found.withColumn("pairs", F.transform(F.arrays_zip(theirs.alias("i"), mine.alias("d")), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))))
    return _judged(x, F.size("pairs"), F.size("pairs"))


def _consistent(found: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """The runs (doc_id, rid, key, hits, covered, own) with consistent slots, for each item of their line."""
    need = small_side(found.select(F.col("rid").alias("need")).distinct())  # broadcast, so that other texts aren't shuffled
    texts = rows.join(need, F.col("rid") == F.col("need"), "left_semi").dropDuplicates(["rid"])
    raw = spaced(F.col("text"))
    texts = texts.select(F.col("rid").alias("of"), _slots(template(raw), raw).alias("mine"))
    theirs = items.select(F.col("key").alias("for"), "item_id", _slots(template(F.col("raw")), F.col("raw")).alias("theirs"))
    # the run's main offset is that of most windows; a word of the item is compared where it is nearest to it
    offsets = F.transform("hits", lambda h: h["at"] - h["spot"])
    x = found.withColumn("offsets", offsets)
    x = x.withColumn("main", F.array_max(F.transform(F.array_distinct("offsets"), lambda o: F.struct(F.size(F.filter("offsets", lambda y: y == o)).alias("n"), o.alias("o"))))["o"])
    places = F.transform("hits", lambda h: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda d: F.struct((h["spot"] + d).alias("i"), F.abs(h["at"] - h["spot"] - F.col("main")).alias("far"), (h["at"] + d).alias("p"))))
    x = x.withColumn("places", F.array_sort(F.array_distinct(F.flatten(places))))
    x = x.withColumn("places", F.filter("places", lambda y, k: (k == 0) | (F.get("places", k - 1)["i"] != y["i"])))
    x = x.join(texts, F.col("rid") == F.col("of")).join(theirs, F.col("key") == F.col("for"))
    x = x.withColumn("pairs", F.transform("places", lambda y: F.struct(F.get("theirs", y["i"]).alias("i"), F.get("mine", y["p"]).alias("d"))))
    return _judged(x, F.col("covered"), F.col("own"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns are those of docs, whatever their names."""
    gone = small_side(stash(leaks(docs, benchmark).select("rid").distinct(), "leaks"))
    return docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == gone["rid"], "left_anti")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """leaks() of all documents and benchmark items."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("rid")
