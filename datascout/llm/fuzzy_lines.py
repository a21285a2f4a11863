"""Fuzzy line dedup (operator 10).

Lines are normalised (case, digits, punctuation and white space) and fingerprinted by SimHash in blocks (see blocks.py): each block is
the SimHash of four of the line's words, drawn in favour of long ones.  Lines that agree on a block are compared by edit
similarity; links make connected groups, and of each group only the first occurrence (by doc_id, then line) stays in the corpus.
Exact repeats of a normalised line are one line, whatever its length.

A single SimHash of all words finds one pair in nine that differs in one word; blocks find 92 % or more of the pairs whose edits replace,
drop or add up to a fifth of their words (tests state the figures), and 80 to 90 % of those that misspell every fifth word.

Only hashes go to the groups at first; texts follow for the lines that have a partner.  Hot blocks are split, see groups.py.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_prints
from .common import read_table, stash
from .components import connected_components
from .groups import group_links
from .language_model import slices
from .tokens import as_bytes, words_of

#: Fewest words of a line that can be like another; edit similarity from which it is.
MIN_WORDS, SIMILARITY = 5, 0.8
#: Blocks of a line, and words of each; lines of few words have more, of three words each.
BLOCKS, WORDS, SHORT, SHORT_BLOCKS = 10, 4, 9, 8
#: Hash bins of three-letter runs, which bound the edit distance from below.
BINS = 1024
#: Words are drawn in proportion to their length, up to LONGEST bytes, to the power of LEAN.
LONGEST, LEAN = 12, 2.0
#: Bytes of a tiny word; other words that are enough for a line to be known by them alone.
TINY, ENOUGH = 3, 8
#: Fewest lines of a group whose words are compared by place; words that a common start or end may put in or leave out.
PLACED, EDGE_WORDS = 64, 16
#: Fewest lines that are compared with one at once, and most; longest of such lines, as all their letters meet.
TOGETHER, MOST_TOGETHER, SHORT_ENOUGH = 8, 128, 1000
_PLAIN = bytes(48 if 48 <= x < 58 else 32 if x < 128 and not chr(x).isalnum() else ord(chr(x).lower()) if x < 128 else x for x in range(256))
_LINES = _PLAIN[:10] + b"\n" + _PLAIN[11:]
_EASE = (np.maximum(np.arange(LONGEST + 1), 1.0) ** -LEAN).astype(np.float32)


def normalised(line: bytes) -> bytes:
    """Lower-cased (A-Z), digits as 0, other ASCII signs as space, one space between words."""
    return b" ".join(line.translate(_PLAIN).split())


def split_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text, place, normalised line) of every line of the texts that has a word."""
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    buf = np.frombuffer((b"\n" + b"\n".join(texts) + b"\n").translate(_LINES), dtype=np.uint8)  # all white space is a space or a line's end
    gap = buf <= 32
    buf = buf[1:][~(gap[:-1] & (buf[1:] == 32))]
    buf = buf[np.append(~((buf[:-1] == 32) & (buf[1:] == 10)), True)]
    lines = buf.tobytes().split(b"\n")[:-1]
    n = np.array([x.count(b"\n") + 1 for x in texts])
    some = np.flatnonzero(np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)))
    row = np.repeat(np.arange(len(n)), n)[some]
    return row, some - (np.cumsum(n) - n)[row], list(filter(None, lines))


def fingerprints(lines: list[bytes]) -> list[bytes]:
    """The blocks of each line as bytes; every line has a word.  Very short words count only in lines that have few others."""
    if not lines:
        return []
    h, size, n = words_of(lines)
    line = np.repeat(np.arange(len(n)), n)
    long = size > TINY
    keep = long | (np.bincount(line[long], minlength=len(n)) < ENOUGH)[line]
    h, ease, m = h[keep], _EASE[np.minimum(size[keep], LONGEST)], np.bincount(line[keep], minlength=len(n))
    made = _rows(block_prints(h, np.cumsum(m) - m, BLOCKS, WORDS, ease))
    short = np.flatnonzero(n <= SHORT)
    if len(short):
        at = np.repeat(n <= SHORT, m)
        more = block_prints(h[at], np.cumsum(m[short]) - m[short], SHORT_BLOCKS, 3, ease[at])
        for i, x in zip(short.tolist(), _rows(more)):
            made[i] += x
    return made


def _rows(x: np.ndarray) -> list[bytes]:
    every, size = x.tobytes(), x.itemsize * x.shape[1]
    return [every[k : k + size] for k in range(0, len(every), size)]


def _shared(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """a and b without their common start and end, which the edit distance does not depend on."""
    k = _shared(a, b)
    a, b = a[k:], b[k:]
    k = _shared(a[::-1], b[::-1])
    return a[: len(a) - k], b[: len(b) - k]


def edit_distance(a: str, b: str, room: float = float("inf")) -> float:
    """Levenshtein distance, all rows of a column at once in the bits of an integer; infinite as soon as it is known to be above room."""
    a, b = _trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)  # where a column rises and falls by one from row to row
    most = room + len(b)
    for c in b:
        hit = at.get(c, 0) | down
        flat = (((hit & up) + up) ^ up) | hit
        rise, fall = (down | ~(up | flat)) & every, up & flat
        distance += bool(rise & top) - bool(fall & top)
        most -= 1
        if distance > most:  # each column that follows takes one off at most
            return float("inf")
        rise = rise << 1 | 1
        up, down = (fall << 1 | ~(rise | flat)) & every, rise & flat & every
    return distance


def edit_distances(a: str, others: list[str]) -> np.ndarray:
    """edit_distance() of a to each of others: their bits lie side by side in one integer, each with a free bit after it."""
    code = np.frombuffer(("\n".join(others) + "\n").encode("utf-32-le"), dtype=np.uint32)
    free = np.zeros(len(code), dtype=bool)
    free[np.cumsum([len(x) + 1 for x in others]) - 1] = True
    first = np.r_[True, free[:-1]]
    every, lowest, at = _packed(~free), _packed(first), {c: _packed(code == ord(c)) for c in set(a)}
    up, down = every, 0
    for c in a:
        hit = at[c] | down
        flat = (((hit & up) + up) ^ up | hit) & every
        rise = (down | (up | flat) ^ every) << 1 | lowest
        up, down = ((up & flat) << 1 | (flat | rise) ^ every) & every, rise & flat
    return len(a) + np.add.reduceat(_bits(up, len(code)) - _bits(down, len(code)), np.flatnonzero(first))


def _packed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _bits(packed: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed.to_bytes(-(-n // 8), "little"), dtype=np.uint8), count=n, bitorder="little").astype(np.int64)


def _in_order(once: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of once (i rises) in which j rises too."""
    if all(p[1] < q[1] for p, q in zip(once, once[1:])):
        return once
    best: list[int] = []
    back, last = [0] * len(once), []
    for k, (_, j) in enumerate(once):
        n = bisect_left(best, j)
        back[k] = last[n - 1] if n else -1
        best[n : n + 1] = [j]
        last[n : n + 1] = [k]
    out, k = [], last[-1]
    while k >= 0:
        out.append(once[k])
        k = back[k]
    return out[::-1]


def aligned(a: str, b: str, room: float) -> bool:
    """Whether an alignment of words costs up to `room` edits: word by word, or at the words that both hold once, in order.

    What an alignment costs is never below the edit distance; it is above it for words that moved.
    """
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y):
        gaps = [(u, v) for u, v in zip(x, y) if u != v]
        if 3 * len(gaps) <= len(x) and _cheap(gaps, room):
            return True
    nx, ny, at = Counter(x), Counter(y), {w: j for j, w in enumerate(y)}
    once = [(i, at[w]) for i, w in enumerate(x) if nx[w] == 1 == ny.get(w)]
    gaps, i, j = [], -1, -1
    for p, q in [*_in_order(once), (len(x), len(y))]:
        if p - i > 1 or q - j > 1:
            u, v = " ".join(x[i + 1 : p]), " ".join(y[j + 1 : q])
            if u != v:
                gaps.append((u + " ", v + " ") if u and v else (u + " " * bool(u), v + " " * bool(v)))
        i, j = p, q
    return _cheap(gaps, room)


def _cheap(gaps: list[tuple[str, str]], room: float) -> bool:
    """Whether the edit distances of all gaps add up to `room` at most."""
    if sum([max(len(u), len(v)) for u, v in gaps]) <= room:
        return True
    if sum([abs(len(u) - len(v)) for u, v in gaps]) > room:
        return False
    for u, v in gaps:
        room -= edit_distance(u, v, room)
        if room < 0:
            return False
    return True


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least `least`, by aligned()."""
    most = max(len(a), len(b))
    room = (1 - least) * most + 1e-9
    if abs(len(a) - len(b)) > room:
        return False
    x, y = _trimmed(a, b)
    return max(len(x), len(y)) <= room or aligned(x, y, room)


def _runs(line: str) -> np.ndarray:
    """How many of the line's three-letter runs fall into each bin."""
    x = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
    g = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
    return np.bincount(g >> np.uint32(22), minlength=BINS).astype(np.int32)


def _elsewhere(lines: list[str]) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """Tells that lines aren't similar by where the words are that both hold once: lines that share a passage, say, which moved too far.

    An alignment by words moved by d costs |d| edits before them and |more letters - d| after them at least, and aligned() takes most such words
    that are in order, so at least as many as moved alike by any one d.  If fewer words than these moved by an affordable d, it costs
    too much.  Similar() cuts a common start and end, which changes but EDGE_WORDS words where first and last words differ.
    """
    split = [x.split(" ") for x in lines]
    known: dict[str, int] = {}
    word, line, place = [], [], []
    for k, x in enumerate(split):
        n, at = Counter(x), 0
        for w in x:
            if n[w] == 1:
                word.append(known.setdefault(w, len(known)))
                line.append(k)
                place.append(at)
            at += len(w) + 1
    word, line, place = (np.array(x, dtype=np.int64) for x in (word, line, place))
    start = np.searchsorted(line, np.arange(len(lines) + 1))
    ends = np.array([[known.setdefault(x[0], len(known)), known.setdefault(x[-1], len(known))] for x in split])
    edge, count, size = (np.array(x) for x in ([len(x[0]) + len(x[-1]) for x in split], [len(x) for x in split], [len(x) for x in lines]))

    def elsewhere(i: int, js: np.ndarray, room: np.ndarray) -> np.ndarray:
        own, most = np.full(len(known), -1), np.full(len(lines), -1)
        own[word[start[i] : start[i + 1]]] = place[start[i] : start[i + 1]]
        most[js] = room
        both = np.flatnonzero((own[word] >= 0) & (most[line] >= 0))
        of, moved = line[both], place[both] - own[word[both]]
        cheap = np.abs(moved) + np.abs(size[of] - size[i] - moved) <= most[of] + 2
        few = np.bincount(of[cheap], minlength=len(lines)) + EDGE_WORDS
        key = np.sort((of << 32) + moved + (1 << 31))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        alike = np.zeros(len(lines), dtype=np.int64)
        np.maximum.at(alike, key[first] >> 32, np.diff(np.r_[first, len(key)]))
        apart = (ends[js] != ends[i]).all(axis=1) & (count[js] != count[i]) & (np.maximum(size[js], size[i]) - np.maximum(edge[js], edge[i]) > room)
        return apart & (alike > few)[js]

    return elsewhere


def near_lines(lines: list[str], least: float = SIMILARITY) -> Callable[[int, np.ndarray], np.ndarray]:
    """An edit changes at most three of a line's three-letter runs, so lines that share too few can't be similar.

    Runs are counted where there are more than two lines: one pair is compared at less cost.  In larger groups, lines whose words are too
    far elsewhere go next, then, many at once, those whose edit distance is too large: no alignment costs less.
    """
    if len(lines) == 2:
        return lambda i, js: np.array([similar(lines[i], lines[j], least) for j in js])
    size = np.array([len(x) for x in lines])
    runs = np.stack([_runs(x) for x in lines])
    elsewhere = None

    def near(i: int, js: np.ndarray) -> np.ndarray:
        nonlocal elsewhere
        most = np.maximum(size[js], size[i])
        room = np.floor((1 - least) * most + 1e-9).astype(np.int64)
        hit = np.abs(size[js] - size[i]) <= room
        if hit.any():
            hit[hit] = np.minimum(runs[js[hit]], runs[i]).sum(axis=1) >= (most - 2 - 3 * room)[hit]
        if len(lines) >= PLACED and np.count_nonzero(hit) >= TOGETHER:
            elsewhere = elsewhere or _elsewhere(lines)
            hit[hit] = ~elsewhere(i, js[hit], room[hit])
            left = np.flatnonzero(hit & (most <= SHORT_ENOUGH))
            for some in np.array_split(left, -(-len(left) // MOST_TOGETHER)) if len(left) >= TOGETHER else ():
                hit[some] = edit_distances(lines[i], [lines[j] for j in js[some].tolist()]) <= room[some]
        for k in np.flatnonzero(hit).tolist():
            hit[k] = similar(lines[i], lines[js[k]], least)
        return hit

    return near


def lines_of(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, line, h, prints) of every line of docs (rid, doc_id, text) with a word.

    prints: the line's blocks; null below MIN_WORDS, and for a line that was met before in the same part of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        seen: set[int] = set()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for i, j in slices(texts):
                row, line, norm = split_lines(texts[i:j])
                hashes = list(map(xxh64_intdigest, norm))
                new = []
                for k, (x, h) in enumerate(zip(norm, hashes)):
                    if h not in seen and x.count(b" ") >= MIN_WORDS - 1:
                        seen.add(h)
                        new.append(k)
                prints: list[bytes | None] = [None] * len(norm)
                for k, x in zip(new, fingerprints([norm[k] for k in new])):
                    prints[k] = x
                if norm:
                    at = pa.array(row + i)
                    h = np.array(hashes, dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column("rid").take(at), batch.column("doc_id").take(at), pa.array(line.astype(np.int32)), pa.array(h), pa.array(prints, pa.binary())], names=["rid", "doc_id", "line", "h", "prints"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, line int, h long, prints binary")


def _attach(docs: DataFrame, of_rows: DataFrame, how: str) -> DataFrame:
    """docs joined with of_rows (rid, ...; one row a rid); Spark broadcasts these only if they turn out to be tiny."""
    return docs.join(of_rows.withColumnRenamed("rid", "of"), F.col("rid") == F.col("of"), how).drop("of")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, payload) for wanted (rid, line, h), a row each: payload is the normalised line."""
    each = wanted.groupBy("rid").agg(F.collect_list(F.struct("line", "h")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, lines = [], []
            for text, want in zip(as_bytes(batch.column("text")), batch.column("want").to_pylist()):
                own = text.split(b"\n")
                for w in want:
                    hs.append(w["h"])
                    lines.append(normalised(own[w["line"]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(lines, pa.string())], names=["h", "payload"])

    return _attach(docs.select("rid", "text"), each, "inner").mapInArrow(run, "h long, payload string").dropDuplicates(["h"])


def rid(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def repeats(docs: DataFrame) -> DataFrame:
    """(rid, lines): places of the lines of docs (rid, doc_id, text) that repeat an earlier line of the corpus."""
    lines = stash(lines_of(docs), "fuzzy_lines")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "line").alias("first")
    reps = stash(lines.groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "fuzzy_reps")

    def attach(members: DataFrame) -> DataFrame:
        own = members.join(reps.select(F.col("h").alias("k"), "first"), F.col("h") == F.col("k"))
        return _texts(docs, own.select("first.rid", "first.line", "h"))

    prints = lines.where("prints IS NOT NULL").select("h", "prints")
    links = group_links(prints, attach, near_lines, "fuzzy")
    groups = connected_components(links, "fuzzy_links").withColumnRenamed("node", "k")
    of = reps.join(groups, F.col("h") == F.col("k"), "left").where("n > 1 OR component IS NOT NULL").select("h", "first", F.coalesce("component", "h").alias("c"))
    least = of.groupBy("c").agg(F.min("first").alias("keep")).withColumnRenamed("c", "k")
    keep = of.join(least, F.col("c") == F.col("k")).select(F.col("h").alias("k"), F.col("keep.rid").alias("keep_rid"), F.col("keep.line").alias("keep_line"))
    gone = lines.select("rid", "line", "h").join(keep, F.col("h") == F.col("k")).where("rid <> keep_rid OR line <> keep_line")
    return gone.groupBy("rid").agg(F.collect_set("line").alias("lines"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text without the repeats, n_lines, n_removed and kept_sha256 of the new text.

    Lines without a word always stay; lines of fewer than MIN_WORDS words go only if they repeat another exactly, once normalised.  Null
    text: no line, and an empty new text; empty text: one empty line.  A null doc_id comes last in order.  Rows that repeat id and text
    are one document: all keep the same lines; rows that repeat the id only are different documents.  No size is capped.  Lines
    are named by 64-bit hashes.
    """
    rows = docs.select(rid(docs).alias("rid"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("lines").to_pylist()):
                lines, gone = [] if text is None else text.split(b"\n"), set(gone or ())
                texts.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone] if gone else lines))
                n.append(len(lines))
                removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], names=["doc_id", "text", "n_lines", "n_removed", "kept_sha256"])

    return _attach(rows, repeats(rows), "left").mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long, kept_sha256 string")


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() over all documents, without the texts."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("text")
