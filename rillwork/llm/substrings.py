"""Substring deduplication by prefix-partitioned suffix trees over words.

A window is ``length`` consecutive words. Only some suffixes need to enter a tree: in each window the
smallest hash of its 8-word prefixes marks an anchor (the leftmost on ties), so equal windows have
equal anchors at equal offsets. Consecutive windows with one anchor form a segment. Segments of
an anchor that occurs once hold nothing repeated and go no further; segments of equal content are
all repeated. What remains is partitioned by prefixes of varying length, so that a group fits in memory: all
distinct segments of one anchor (an 8-word prefix) make a group if there are at most ``GROUP``, and a suffix
tree is built of it top down, an edge being seven words; nodes at the window's depth with two or
more leaves are the repeats. Suffixes of a more frequent anchor are partitioned by longer prefixes, each by the shortest of
14, 21, 28, ... words that at most ``GROUP`` of them share, and each such group makes a tree. A group that is still larger at the
whole window is one node at that depth already, and its leaves are counted before they are shuffled.

Equal segments are known by two independent hashes of 64 bits (anchor and digest), equal windows by their words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import WORD, group_starts, map_batches, map_groups, materialize, read_table, utf8, with_default_columns

PREFIX, EDGE = 8, 7
#: Most distinct segments of an anchor, or suffixes with a longer prefix, that one tree takes.
GROUP = 2048
#: Words of a document handled at once.
PIECE = 1 << 17
NO_ID = -(1 << 63)


def segments_of(words: list[list[bytes]], length: int) -> dict:
    """Segments of some documents: document number, first window, number of windows, anchor, digest, text."""
    pieces = [(i, s, w[s : s + PIECE + length - 1]) for i, w in enumerate(words) for s in range(0, len(w) - length + 1, PIECE)]
    out = {k: [] for k in ("doc", "lo", "n", "anchor", "digest", "text")}
    while pieces:
        taken, total = [], 0
        while pieces and (not taken or total < PIECE):
            taken.append(pieces.pop(0))
            total += len(taken[-1][2])
        flat = [w for p in taken for w in p[2]]
        size = np.array([len(p[2]) for p in taken])
        piece = np.repeat(np.arange(len(taken)), size)
        h = pd.util.hash_array(np.array(flat, dtype=object), categorize=True)
        grams = len(flat) - PREFIX + 1
        rolled = np.zeros(grams, np.uint64)
        for j in range(PREFIX):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + grams]
        rolled = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(29)
        low = np.uint64((1 << 24) - 1)
        best = (rolled & ~low) | np.arange(grams, dtype=np.uint64)
        span, need = 1, length - PREFIX + 1
        while span * 2 <= need:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if need > span:
            best = np.minimum(best[: len(best) - (need - span)], best[need - span :])
        at = (best & low).astype(np.int64)  # the anchor of each window
        whole = piece[: len(at)] == piece[length - 1 :]
        new = whole.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~whole[:-1]
        lo = np.flatnonzero(new)
        ends = np.flatnonzero(whole & np.append((at[1:] != at[:-1]) | ~whole[1:], True)) + 1
        joined = b" ".join(flat)
        width = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        stop = np.cumsum(width) - 1
        begin = (stop - width + 1)[lo].tolist()
        texts = [joined[s:e] for s, e in zip(begin, stop[ends + length - 2].tolist(), strict=True)]
        first = np.cumsum(size) - size
        out["doc"].append(np.array([p[0] for p in taken])[piece[lo]])
        out["lo"].append(np.array([p[1] for p in taken])[piece[lo]] + lo - first[piece[lo]])
        out["n"].append(ends - lo)
        out["anchor"].append(rolled[at[lo]].view(np.int64))
        out["digest"].append(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64))
        out["text"] += texts
    return {k: v if k == "text" else np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def repeated_windows(texts: list[bytes], offsets: list[range], length: int) -> list[tuple[int, int]]:
    """(text, offset) of each window that occurs twice or more, from a suffix tree built top down."""
    words = [t.split(b" ") for t in texts]
    edges = [*range(0, length, EDGE), length]
    stack = [([(i, o) for i, r in enumerate(offsets) for o in r], 0)]
    found = []
    while stack:
        leaves, k = stack.pop()
        if k == len(edges) - 1:
            found += leaves
            continue
        below: dict = {}
        a, b = edges[k], edges[k + 1]
        for leaf in leaves:
            i, o = leaf
            below.setdefault(tuple(words[i][o + a : o + b]), []).append(leaf)
        stack += [(x, k + 1) for x in below.values() if len(x) > 1]
    return found


def _packed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, id, h, z): join key and compressed text."""

    def make():
        pack = zstandard.ZstdCompressor(level=1)

        def step(c: dict) -> dict:
            texts = utf8(c["text"])
            ids = c["doc_id"].fill_null(NO_ID)
            h = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            return {"doc_id": c["doc_id"], "id": ids, "h": h, "z": [pack.compress(t) for t in texts]}

        return step

    return map_batches(with_default_columns(docs, doc_id="bigint", text="string"), make, "doc_id bigint, id bigint, h bigint, z binary")


def _slices(n: int, rows: int = 500):
    return [(s, min(n, s + rows)) for s in range(0, n, rows)]


def _segments(docs: DataFrame, length: int) -> DataFrame:
    schema = "id bigint, h bigint, lo int, n int, anchor bigint, digest bigint"

    def make():
        def step(c: dict) -> dict:
            texts, ids = utf8(c["text"]), np.asarray(c["doc_id"].fill_null(NO_ID))
            h = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            out = {k: [] for k in ("id", "h", "lo", "n", "anchor", "digest")}
            for s, e in _slices(len(texts)):
                x = segments_of([WORD.findall(t) for t in texts[s:e]], length)
                for k, v in (("id", ids[s:e][x["doc"]]), ("h", h[s:e][x["doc"]]), *((k, x[k]) for k in ("lo", "n", "anchor", "digest"))):
                    out[k].append(v)
            return {k: np.concatenate(v) for k, v in out.items()}

        return step

    return map_batches(with_default_columns(docs, doc_id="bigint", text="string"), make, schema)


def prefix_lengths(length: int) -> list[int]:
    """The longer prefixes of a window, in words, up to the whole window."""
    return [*range(2 * EDGE, length, EDGE), length]


def _wanted(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The text of each wanted segment, or, where its anchor is ``hot``, each of its windows with its prefixes' hashes."""
    schema = "anchor bigint, digest bigint, count bigint, off int, prefixes array<bigint>, text binary"
    cuts = prefix_lengths(length)
    hashed = lambda words: xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)

    def make():
        unpack = zstandard.ZstdDecompressor()

        def step(c: dict) -> dict:
            out: dict = {k: [] for k in ("anchor", "digest", "count", "off", "prefixes", "text")}
            want = [{(s["anchor"], s["digest"]): (s["count"], s["hot"]) for s in x} for x in c["segments"].to_pylist()]
            data = c["z"].to_pylist()
            for s, e in _slices(len(data), 200):
                x = segments_of([WORD.findall(unpack.decompress(z)) for z in data[s:e]], length)
                for d, a, g, n, t in zip(x["doc"].tolist(), x["anchor"].tolist(), x["digest"].tolist(), x["n"].tolist(), x["text"], strict=True):
                    count, hot = want[s + d].pop((a, g), (0, False))
                    if not count:
                        continue
                    words = t.split(b" ") if hot else []
                    for o in range(n) if hot else [0]:
                        prefixes = [hashed(words[o : o + cut]) for cut in cuts] if hot else None
                        for k, v in (("anchor", a), ("digest", g), ("count", count), ("off", o), ("prefixes", prefixes), ("text", b" ".join(words[o : o + length]) if hot else t)):
                            out[k].append(v)
            return out

        return step

    return map_batches(docs.dropDuplicates(["id", "h"]).join(wanted, ["id", "h"]).select("z", "segments"), make, schema)


def _trees(length: int, key: str):
    """Whole groups of one ``key`` to the repeated windows of the segments that occur once; ``off`` is a text's place in its segment."""

    def step(c: dict) -> dict:
        out: dict = {"anchor": [], "digest": [], "off": [], "len": []}
        starts, first = group_starts([c[key]]), np.asarray(c["off"])
        texts, counts = c["text"].to_pylist(), np.asarray(c["count"])
        anchor, digest = np.asarray(c["anchor"]), np.asarray(c["digest"])
        for s, e in zip(starts, np.append(starts[1:], len(texts)), strict=True):
            if e - s < 2:
                continue
            offsets = [range(t.count(b" ") + 2 - length) for t in texts[s:e]]
            for i, o in repeated_windows(texts[s:e], offsets, length):
                if counts[s + i] == 1:
                    for k, v in (("anchor", anchor[s + i]), ("digest", digest[s + i]), ("off", first[s + i] + o), ("len", 1)):
                        out[k].append(v)
        return out

    return step


def _hot_repeats(windows: DataFrame, length: int) -> DataFrame:
    """windows(anchor, digest, count, off, prefixes, text) of frequent anchors -> (anchor, digest, off, len) of the repeated ones.

    Windows are counted by their prefixes' hashes first, so that equal ones count as one row with its number. A window goes by its shortest prefix that GROUP or fewer
    share, or by the whole; one whose prefix no other has goes no further. Texts are shuffled to their trees only.
    """
    last = len(prefix_lengths(length)) - 1
    distinct = materialize(windows.groupBy("prefixes").agg(F.count("*").alias("n")), "distinct-windows")
    ends = distinct.select("n", "prefixes", F.posexplode("prefixes").alias("level", "prefix"))
    counted = ends.groupBy("level", "prefix").agg(F.sum("n").alias("k"), F.first(F.get("prefixes", F.col("level") - 1)).alias("shorter"))
    counted = materialize(counted.where("k > 1"), "long-prefixes")
    split = counted.where(F.col("k") > GROUP).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("shorter"))
    fits = counted.where((F.col("k") <= GROUP) | (F.col("level") == last))
    groups = fits.where("level = 0").unionByName(fits.where("level > 0").join(split, ["level", "shorter"], "left_semi").select(*fits.columns))
    at = ends.join(groups.select("level", "prefix", (F.col("k") <= GROUP).alias("tree")), ["level", "prefix"])
    at = at.select("prefixes", F.col("prefix").alias("group"), "tree")
    kept = materialize(windows.join(at, "prefixes").drop("prefixes"), "long-groups")
    small = kept.where("tree").select("group", "anchor", "digest", "count", "off", "text").repartition("group").sortWithinPartitions("group")
    from_trees = map_groups(small, ["group"], _trees(length, "group"), "anchor bigint, digest bigint, off int, len int")
    whole = kept.where("not tree")
    found = materialize(whole.groupBy("group", "text").agg(F.count("*").alias("k")).where("k > 1").select("group", "text"), "repeated-windows")
    return from_trees.unionByName(whole.where("count = 1").join(found, ["group", "text"], "left_semi").select("anchor", "digest", "off", F.lit(1).alias("len")))


def repeated_ranges(docs: DataFrame, length: int = 35) -> DataFrame:
    """(id, h, ranges): for each document with repeats, the word ranges [s, e) that repeated windows cover."""
    if length < PREFIX:
        raise ValueError(f"a window has at least {PREFIX} words")
    segments = materialize(_segments(docs, length), "segments")
    again = materialize(segments.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "anchors")
    segments = materialize(segments.join(again, "anchor", "left_semi"), "repeated-segments")
    classes = materialize(segments.groupBy("anchor", "digest").agg(F.count("*").alias("count"), F.min(F.struct("id", "h")).alias("rep")), "segment-classes")
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.max((F.col("count") == 1).cast("int")).alias("single"))
    mixed = materialize(mixed.where("k > 1 and single = 1").select("anchor", (F.col("k") > GROUP).alias("hot")), "mixed-anchors")
    wanted = classes.join(mixed, "anchor").groupBy("rep.id", "rep.h").agg(F.collect_list(F.struct("anchor", "digest", "count", "hot")).alias("segments"))
    texts = materialize(_wanted(_packed(docs), materialize(wanted, "wanted"), length), "segment-texts")
    trees = texts.where("prefixes is null").select("anchor", "digest", "count", "off", "text").repartition("anchor").sortWithinPartitions("anchor")
    from_trees = map_groups(trees, ["anchor"], _trees(length, "anchor"), "anchor bigint, digest bigint, off int, len int")
    from_long = _hot_repeats(texts.where("prefixes is not null"), length)
    copies = classes.where("count > 1").select("anchor", "digest", F.lit(0).alias("off"), F.lit(None).cast("int").alias("len"))
    repeats = materialize(copies.unionByName(from_trees).unionByName(from_long), "repeats")
    at = segments.join(repeats, ["anchor", "digest"]).select("id", "h", (F.col("lo") + F.col("off")).alias("s"), (F.col("lo") + F.col("off") + F.coalesce("len", "n") - 1 + length).alias("e"))
    return materialize(at.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("ranges")), "ranges")


def keep_mask(n: int, ranges: list | None) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        edge[r["s"]] += 1
        edge[r["e"]] -= 1
    return np.cumsum(edge)[:n] == 0


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, kept: binary).

    Removes every word that a window covers whose words also start anywhere else. A null or empty
    text has no words; repeated rows are occurrences like any other, so their windows all go.
    ``kept`` is the kept words joined by one space. An empty table gives an empty result; other columns, whatever their
    names, are ignored.
    """
    packed = _packed(docs)

    def make():
        unpack = zstandard.ZstdDecompressor()

        def step(c: dict) -> dict:
            out: dict = {"doc_id": c["doc_id"], "n_words": [], "n_removed": [], "kept": []}
            for z, ranges in zip(c["z"].to_pylist(), c["ranges"].to_pylist(), strict=True):
                words = WORD.findall(unpack.decompress(z))
                mask = keep_mask(len(words), ranges)
                kept = words if mask.all() else [words[i] for i in np.flatnonzero(mask)]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept"].append(b" ".join(kept))
            return out

        return step

    joined = packed.join(repeated_ranges(docs, length), ["id", "h"], "left").select("doc_id", "z", "ranges")
    return map_batches(joined, make, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def clean(docs: DataFrame, length: int = 35) -> DataFrame:
    """docs with their columns: repeated passages removed from ``text``, ``n_chars`` counted anew if there is one.

    A text that loses words becomes its kept words joined by one space; any other is left as it is.
    """
    keyed, others = _keyed(docs), [n for n in docs.columns if n != "text"]

    def make():
        def step(c: dict) -> dict:
            texts = c["text"].cast("binary").to_pylist()
            for i, ranges in enumerate(c["__ranges"].to_pylist()):
                if ranges:
                    words = WORD.findall(texts[i])
                    texts[i] = b" ".join([words[k] for k in np.flatnonzero(keep_mask(len(words), ranges))])
            return {n: c[n] for n in others} | {"text": pa.array(texts, pa.binary())}

        return step

    ranges = repeated_ranges(docs, length).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("ranges").alias("__ranges"))
    joined = keyed.join(ranges, ["__id", "__h"], "left").drop("__id", "__h")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.withColumn("text", F.col("text").cast("string")).schema)
    out = map_batches(joined, make, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __id and __h, the keys of ``repeated_ranges``."""

    def make():
        def step(c: dict) -> dict:
            h = [xxhash.xxh3_64_intdigest(t) for t in utf8(c["text"])]
            ids = c["doc_id"] if "doc_id" in c else pa.nulls(len(h), pa.int64())
            return c | {"__id": ids.cast("int64").fill_null(NO_ID), "__h": np.array(h, np.uint64).view(np.int64)}

        return step

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.withColumn("text", F.col("text").cast("string")).schema]
    return map_batches(docs.withColumn("text", F.col("text").cast("string")), make, ", ".join([*fields, "__id bigint", "__h bigint"]))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
