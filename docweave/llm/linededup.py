"""Removal of recurring lines by a log-template tree.

Lines are cut at line ends and at sentence ends, so that a passage pasted into the
middle of a line is seen too. The tree has fixed depth: token count, then the leading
tokens (a token with a digit is a wildcard). In a leaf, a token that enough documents
have at its place is constant and any other token is a variable field; lines with the
same constants are one template. Enough is min_docs, four times as many, and so on up to
the leaf's documents, each a template of its own: values of a field are variable at some
level however large the table. A template recurs if min_docs documents have lines of it, a
frequent line is of it, or it is a frequent line but for one token. Short segments (under
least_tokens) count as whole lines, as they are, and together with the long segment beside them.

Recurring templates go, unless their documents are copies of each other. A document is a
copy if recurring templates cover it: all of its text; SAME of it in three segments or more
(a similarity of 0.75); or MOST of it, in five segments or more and with short gaps only,
as edits leave them. A copy's class is the least hash of its templates, which copies have in
common whatever their edits; a document that is no copy is a class of its own. A template goes
where its documents are of min_docs classes, and two more for each time that its documents are
twice its classes: so many the edits of one group do not make. From copies it goes only if its classes
are half its documents; their own lines stay, for near-duplicate removal to judge them.

Scale: the first pass emits one hash a line and counts documents a leaf; a bitmap of
fixed size tells the second pass which lines to emit with their tokens, and templates are
mined on distinct lines with their counts. Every grouping is a partial sum first, and joins
on a line or template broadcast the few keys that hold more than 1/4096 of the rows: no leaf,
line or template, however frequent, is gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, skew_join
from ._vec import _C, batches, mix, scan, slices, table, test_bits
from .decontam import bitmap_of, row_key

BITS = 25
SAME, MOST = 6 / 7, 0.6  #: of a copy's text; 6/7 of it in common make a similarity of 0.75
GAP = 200  #: bytes, about 30 words
_WILD = np.uint64(0x2A)
_END = table(b".!?")


def segments(texts: list[bytes]):
    """Where texts begin (and one end), word starts, token hashes (digits: wildcard), first word
    of each segment with the end, the text that each belongs to, word hashes, and line of each segment."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    w = scan(b"\n".join(texts))
    n = len(w.starts)
    if not n:
        none = np.zeros(0, np.int64)
        return begins, w.starts, np.zeros(0, np.uint64), np.zeros(1, np.int64), none, np.zeros(0, np.uint64), none
    token = np.where(w.digit, _WILD, w.hash)
    new = np.concatenate(([True], (w.line[1:] > w.line[:-1]) | _END[w.last[:-1]]))
    first = np.flatnonzero(new)
    return begins, w.starts, token, np.append(first, n), np.searchsorted(begins, w.starts[first], "right") - 1, w.hash, w.line[first]


def _exact(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of the tokens of each segment."""
    size = np.diff(first)
    place = (np.arange(len(token)) - np.repeat(first[:-1], size)).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token + place * _C[9]))))
    return mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))


def _leaves(token: np.ndarray, first: np.ndarray, depth: int, least: int):
    """Of segments of least tokens or more: their numbers, token counts and leaf."""
    size = np.diff(first)
    own = np.flatnonzero(size >= least)
    a, n = first[own], size[own]
    leaf = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(depth):
        leaf = leaf + token[a + j] * _C[j]
    return own, n, mix(leaf)


def _chains(exact: np.ndarray, owner: np.ndarray, size: np.ndarray, least: int):
    """Units of several segments: a segment of least tokens or more with the shorter ones that
    follow it, up to each of them, and likewise before it. First segment, end, hash and the
    longer segment of each."""
    n = len(exact)
    at = np.arange(n)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for flip in (False, True):
        h, who, long = (x[::-1] if flip else x for x in (exact, owner, size >= least))
        anchor = np.maximum.accumulate(np.where(long, at, -1))
        own = np.flatnonzero(~long & (anchor >= 0) & (who == who[np.maximum(anchor, 0)]))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + (at - anchor).astype(np.uint64) * _C[10]))))
        a, b = anchor[own], own + 1
        hashed = mix(total[b] - total[a] + _C[11 + flip])
        out.append((n - b, n - a, hashed, n - 1 - a) if flip else (a, b, hashed, a))
    return tuple(np.concatenate(x) for x in zip(*out))


def _physical(word: np.ndarray, first: np.ndarray, row: np.ndarray, least: int):
    """Units of whole lines that have a segment of under least tokens: first segment, end and
    hash of the words as they are."""
    own = np.flatnonzero(np.diff(row, prepend=-1))
    end = np.append(own[1:], len(row))
    short = np.concatenate(([0], np.cumsum(np.diff(first) < least)))
    keep = short[end] > short[own]
    return own[keep], end[keep], mix(_exact(word, first[np.append(own, len(row))])[keep] + _C[13])


def _lines(depth: int, least: int, bitmap: bytes | None):
    """Without a bitmap: the leaves of each document's long segments and whole lines. With one:
    the units whose leaf it holds; of a chain, that of its long segment."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            texts = [(x or "").encode() for x in batch.column(0).to_pylist()]
            keys = None if bitmap is None else np.array(batch.column(1).to_pylist(), np.int64)
            for a, b in batches(texts):
                begins, starts, token, first, owner, word, row = segments(texts[a:b])
                if not len(owner):
                    continue
                size = np.diff(first)
                own, n, leaf = _leaves(token, first, depth, least)
                line_head, line_tail, line_hash = _physical(word, first, row, least)
                if bitmap is None:  # one row for a document and leaf
                    who, leaf = owner[np.concatenate((own, line_head))], np.concatenate((leaf, line_hash))
                    order = np.lexsort((leaf, who))
                    x, y = who[order], leaf[order]
                    new = np.ones(len(x), bool)
                    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(y[new].view(np.int64))], names=["leaf"])
                    continue
                exact = _exact(token, first)
                keep = test_bits(bitmap, leaf)
                anchors = np.zeros(len(owner), bool)
                anchors[own[keep]] = True
                head, tail, line, anchor = _chains(exact, owner, size, least)
                chain = anchors[anchor]
                whole = test_bits(bitmap, line_hash)
                head = np.concatenate((own[keep], head[chain], line_head[whole]))
                tail = np.concatenate((own[keep] + 1, tail[chain], line_tail[whole]))
                line = np.concatenate((exact[own[keep]], line[chain], line_hash[whole]))
                n = np.concatenate((n[keep], np.zeros(len(line) - int(keep.sum()), np.int64)))  # only single segments have fields
                leaf = np.concatenate((leaf[keep], line[len(n[n > 0]) :]))
                who = owner[head]
                number = head - np.searchsorted(owner, who)  # of the first segment in its text
                # bytes from the segment's begin to the next one's; the first begins with the text, the last ends with it
                new = np.diff(owner, prepend=-1) > 0
                begin = np.append(np.where(new, 0, starts[first[:-1]] - begins[owner]), 0)
                total = np.diff(begins)[owner] - 1
                ends = np.where(np.append(new[1:], True), total, begin[1:])
                # short segments that follow
                short = np.append((size < least) & ~new, False)
                stop = np.flatnonzero(~short)
                after = stop[np.searchsorted(stop, tail)] - tail
                bounds = np.concatenate(([0], np.cumsum(n)))
                take = np.arange(bounds[-1]) + np.repeat(first[head] - bounds[:-1], n)
                ints = (number, tail - head, begin[head], ends[tail - 1], total[head], after)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a + who]), *(pa.array(x.astype(np.int32)) for x in ints), pa.array(n > 0), pa.array(leaf.view(np.int64)), pa.array(line.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(token[take].view(np.int64)))],
                    names=["key", "number", "span", "a", "b", "bytes", "after", "is_long", "leaf", "line", "tokens"],
                )

    return run


def _rebuild(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(it):
        texts, drops = batch.column("text").to_pylist(), batch.column("docweave_drops").to_pylist()
        done = [_without(text.encode(), drop) if drop else (text, 0) for text, drop in zip(texts, drops)]
        names = [x for x in batch.schema.names if x not in ("text", "docweave_drops")]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=[*names, "text", "n_dropped"])


def _without(raw: bytes, drops: list[dict]) -> tuple[str, int]:
    """The text without the units of drops, and the short segments between two of them; and how many segments went."""
    kept, at, n, number, after = [], 0, 0, 0, 0
    for x in sorted(drops, key=lambda x: (x["number"], -x["span"])):
        end = x["number"] + x["span"]
        if at and x["number"] <= number + after:  # next to what went, or with short segments between
            n += max(0, end - number)
        else:
            kept.append(raw[at : x["a"]])
            n += x["span"]
        if end > number or not at:
            at, number, after = x["b"], end, x["after"]
    kept.append(raw[at:])
    return b"".join(kept).decode(), n


_KEYS = ("one", "two", "odd")  #: least and greatest key of a line's documents, and the exclusive or of all: with up to three, all of them


def _places(depth: int, least_constant: float, bitmap: bytes | None, but_one: bool = False):
    """Of lines (leaf, line, n, three of their documents' keys, tokens): hashes k of leaf, place and token of what may be constant
    beyond the leading tokens, which are the leaf's. Without a bitmap (k, n). With one, the k that it
    holds of lines that have enough of them to be of a template, and how many those need. but_one:
    templates of the line without one of its tokens each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 20_000):
            leaf, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            tokens = pa.concat_arrays([batch.column(6)])
            off = np.asarray(tokens.offsets)
            token = tokens.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(np.uint64)
            size = np.diff(off)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(token)) - np.repeat(off[:-1] - off[0], size)
            known = token != _WILD
            heads = np.bincount(row[known & (place < depth)], minlength=len(size))
            needed = np.maximum(1, np.maximum(4, np.ceil(least_constant * size).astype(np.int64)) - heads)
            own = np.flatnonzero(known & (place >= depth))
            row = row[own]
            k = mix(leaf.view(np.uint64)[row] + mix(token[own] + place[own].astype(np.uint64) * _C[20]))
            if but_one:
                whole = leaf.view(np.uint64).copy()
                np.bitwise_xor.at(whole, row, k)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in range(1, 6)), pa.array((whole[row] ^ k).view(np.int64))], names=["line", "n", *_KEYS, "template"])
            elif bitmap is None:
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n[row])], names=["k", "n"])
            else:
                hit = test_bits(bitmap, k)
                enough = np.bincount(row[hit], minlength=len(size)) >= needed
                hit &= enough[row]
                row, k = row[hit], k[hit]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in range(6)), pa.array(needed[row]), pa.array(k.view(np.int64))], names=["leaf", "line", "n", *_KEYS, "needed", "k"])

    return run


def _templates(lines: DataFrame, min_docs: int, depth: int, least_constant: float) -> DataFrame:
    """(line, template, n): of lines (leaf, line, n documents, keys, tokens) those that recur, with
    the recurring template of most documents that they are of. min_docs is 4 at most: keys are
    all the documents of a rarer line."""
    lines = lines.select("leaf", "line", "n", *_KEYS, "tokens")
    keys = ", ".join(f"{k} long" for k in _KEYS)
    common = lines.mapInArrow(_places(depth, least_constant, None), "k long, n long").groupBy("k").agg(F.sum("n").alias("docs"))
    common = materialise(common.where(F.col("docs") >= min_docs), "common")
    places = lines.mapInArrow(_places(depth, least_constant, bitmap_of(common, "k", BITS)), f"leaf long, line long, n long, {keys}, needed long, k long")
    tagged = skew_join(places, common, "k", "docs").groupBy("leaf", "line", "n", *_KEYS, "needed").agg(F.collect_list(F.struct("docs", "k")).alias("c"), F.max("docs").alias("top"))
    levels = F.sequence(F.lit(0), F.floor(F.log(4.0, F.col("top") / min_docs) + 1e-9).cast("int"))
    # what is constant at each level: min_docs documents, four times as many, and so on
    at_level = lambda j: F.filter("c", lambda x: x.docs >= min_docs * F.pow(F.lit(4.0), j))
    kept = F.transform(levels, lambda j: F.struct(F.size(at_level(j)).alias("size"), F.aggregate(at_level(j), F.col("leaf"), lambda h, x: h.bitwiseXOR(x.k)).alias("template")))
    cand = tagged.where(F.size("c") >= F.col("needed")).select("line", "n", *_KEYS, "needed", F.explode(F.array_distinct(kept)).alias("x"))
    cand = materialise(cand.where(F.col("x.size") >= F.col("needed")).select("line", "n", *_KEYS, "x.template"), "own")
    # a frequent line but for one token is of the template of its rare variants
    often = lines.where(F.col("n") >= min_docs)
    but_one = often.mapInArrow(_places(depth, least_constant, None, but_one=True), f"line long, n long, {keys}, template long")
    rare = cand.where(F.col("n") < min_docs).select("template").distinct()
    cand = materialise(cand.union(but_one.join(rare, "template", "left_semi").select("line", "n", *_KEYS, "template")).distinct(), "templates")
    # a template with a frequent line goes by that line
    frequent = F.max(F.struct("n", "line"))
    sums = cand.groupBy("template").agg(F.sum("n").alias("total"), frequent.alias("top"), F.count("*").alias("n_lines"))
    sums = materialise(sums.select("template", "total", F.col("top.n").alias("most"), F.col("top.line").alias("top"), "n_lines"), "sums")
    some = materialise(sums.where((F.col("most") < min_docs) & (F.col("total") >= min_docs)).select("template", "n_lines"), "some")
    few = skew_join(cand, some, "template", "n_lines")
    third = F.col("odd").bitwiseXOR(F.col("one")).bitwiseXOR(F.col("two"))
    of = F.when(F.col("n") == 1, F.array("one")).when(F.col("n") == 2, F.array("one", "two")).otherwise(F.array(F.col("one"), F.col("two"), third))
    by_docs = few.select("template", F.explode(of).alias("key")).distinct().groupBy("template").count().where(F.col("count") >= min_docs).select("template")
    good = sums.where(F.col("most") >= min_docs).select("template").union(by_docs).join(sums, "template")
    good = good.select("template", "total", F.when(F.col("most") >= min_docs, F.col("top")).otherwise(F.col("template")).alias("id"), "n_lines")
    of_lines = skew_join(cand.select("line", "n", "template"), materialise(good, "good"), "template", "n_lines")
    # of the templates of a line, that of the most documents
    all_of = often.select("line", "n", F.struct(F.col("n").alias("total"), F.col("line").alias("id")).alias("t")).union(of_lines.select("line", "n", F.struct("total", "id")))
    return all_of.groupBy("line").agg(F.max("t").alias("t"), F.max("n").alias("n")).select("line", F.col("t.id").alias("template"), "n")


def recurring_lines(docs: DataFrame, min_docs: int = 4, depth: int = 3, least_tokens: int = 5, least_constant: float = 0.7) -> DataFrame:
    """(key, is_copy, drops): of each document with recurring lines, whether it is a copy, and
    the units that go: number of the first segment, how many, UTF-8 bytes from a to b, and how
    many short segments follow; null if none.

    key is row_key of doc_id and text, so repeated rows count as one document and null
    ids are safe. Texts without words, or null, have no segments."""
    if not 2 <= min_docs <= 4:
        raise ValueError("min_docs is 2 to 4")
    own = docs.select(row_key("doc_id", "text").alias("key"), F.col("text").cast("string"))
    leaves = docs.select(F.col("text").cast("string")).mapInArrow(_lines(depth, least_tokens, None), "leaf long")
    hot = materialise(leaves.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    found = own.select("text", "key").mapInArrow(_lines(depth, least_tokens, bitmap_of(hot, "leaf", BITS)), "key long, number int, span int, a int, b int, bytes int, after int, is_long boolean, leaf long, line long, tokens array<long>")
    found = materialise(found, "lines")
    in_docs = lambda rows, *by: rows.select("key", *by).distinct().groupBy(*by)
    counted = (F.count("*").alias("n"), F.min("key").alias("one"), F.max("key").alias("two"), F.bit_xor("key").alias("odd"))
    tokens = found.where("is_long").groupBy("line").agg(F.min("tokens").alias("tokens"))
    lines = materialise(in_docs(found.where("is_long"), "leaf", "line").agg(*counted).join(tokens, "line"), "distinct")
    others = in_docs(found.where("not is_long"), "line").agg(counted[0]).where(F.col("n") >= min_docs)
    of_long = _templates(lines, min_docs, depth, least_constant)
    line_of = materialise(of_long.union(others.select("line", F.col("line").alias("template"), "n")), "recurring")
    unit = ("a", "b", "number", "span", "after", "is_long", "template")
    seen = skew_join(found.select("key", "number", "span", "a", "b", "bytes", "after", "is_long", "line"), line_of, "line", "n")
    per = seen.groupBy("key").agg(F.max("bytes").alias("bytes"), F.array_sort(F.collect_set(F.struct(*unit))).alias("units"))
    # bytes covered, and the longest stretch between covered ones
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"), F.lit(0).alias("gap"))
    over = F.aggregate("units", start, lambda s, u: F.struct(F.greatest(s.end, u.b).alias("end"), (s.covered + F.greatest(F.lit(0), u.b - F.greatest(s.end, u.a))).alias("covered"), F.greatest(s.gap, u.a - s.end).alias("gap")))
    per = per.withColumn("over", over).withColumn("n_long", F.size(F.filter("units", lambda u: u.is_long)))
    covered, size, gap = F.col("over.covered"), F.col("bytes"), F.greatest("over.gap", F.col("bytes") - F.col("over.end"))
    copy = (covered == size) | ((covered >= SAME * size) & (F.col("n_long") >= 3)) | ((covered >= MOST * size) & (F.col("n_long") >= 5) & (gap <= F.greatest(F.lit(GAP), size / 10)))
    least = F.array_min(F.transform("units", lambda u: F.xxhash64(u.template)))
    per = materialise(per.select("key", copy.alias("is_copy"), F.when(copy, least).otherwise(F.col("key")).alias("class"), "units"), "documents")
    held = per.select("class", F.explode(F.array_distinct(F.transform("units", lambda u: u.template))).alias("template")).groupBy("template", "class").agg(F.count("*").alias("n"))
    held = held.groupBy("template").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_classes"))
    recurs = F.col("n_classes") >= F.floor(F.least(F.lit(min_docs), F.col("n_docs")) + 2 * F.log2(F.col("n_docs") / F.col("n_classes")))
    verdict = materialise(held.where(recurs).select("template", (F.col("n_classes") * 2 >= F.col("n_docs")).alias("in_copies"), F.col("n_docs").alias("n")), "verdict")
    units = per.select("key", "is_copy", F.explode("units").alias("u")).select("key", "is_copy", "u.number", "u.span", "u.a", "u.b", "u.after", "u.template")
    gone = skew_join(units, verdict, "template", "n").where("in_copies or not is_copy").groupBy("key").agg(F.collect_set(F.struct("number", "span", "a", "b", "after")).alias("drops"))
    return per.select("key", "is_copy").join(gone, "key", "left").where("is_copy or drops is not null")


def line_dedup(docs: DataFrame, min_docs: int = 4, depth: int = 3, least_tokens: int = 5) -> DataFrame:
    """docs (doc_id, text and any other columns) with recurring lines taken out of text,
    and columns n_dropped (segments) and is_copy (its lines recur, but in its copies).

    Rows come out as often as they come in; a null text stays null, a text of which all lines go
    is empty. A row that nothing is dropped from is unchanged. Very long texts are read whole.
    Columns of docs named n_dropped or is_copy are replaced; docweave_key and docweave_drops
    are taken for the operator's own and must not be among docs' columns."""
    drops = recurring_lines(docs, min_docs, depth, least_tokens)
    cols = [c for c in docs.columns if c not in ("n_dropped", "is_copy")]
    marked = docs.select(*cols, row_key("doc_id", "text").alias("docweave_key"))
    joined = marked.join(drops.select(F.col("key").alias("docweave_key"), F.coalesce("is_copy", F.lit(False)).alias("is_copy"), F.col("drops").alias("docweave_drops")), "docweave_key", "left").drop("docweave_key")
    rest = [c for c in cols if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), "is_copy boolean", "text string", "n_dropped int"])
    done = joined.select(*rest, F.coalesce("is_copy", F.lit(False)).alias("is_copy"), F.col("text").cast("string").alias("text"), "docweave_drops").mapInArrow(_rebuild, schema)
    return done.select(*cols, "n_dropped", "is_copy")
