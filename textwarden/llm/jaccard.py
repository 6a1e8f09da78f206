"""Jaccard join of documents' word n-gram sets by prefixes of token combinations.

Order and classes. One order of all tokens puts rare ones first: by a count sketch of fixed size over all documents, then by
hash. The sketch only ranks; any order gives the same links. Of a set of n tokens, at most ``n - ceil(t n)`` can be missing
from a partner. Tokens of the rare class (few documents have them) are indexed singly, those of a frequent class in
combinations of k. A class is dealt by hash into parts, and combinations stay in one part. A part can hold k - 1 shared tokens
without a shared combination, so a prefix ends where its rare tokens and, for each part, its tokens beyond the first k - 1 come
to ``n - ceil(t n) + 1``. Any two linked documents then share an indexed token or combination, and a document with so
many tokens of its own that nothing can link with it indexes nothing. Larger sets take more parts; sizes that have
partners in two such ranges of sizes are indexed for both.

Classes without hot keys. A token whose counter in the sketch stands out is frequent by that alone and is never shuffled by
token. Of the others, a token can be in no more sets than its counter says, so dealing them by token makes no large
group; there, tokens of one set only drop out, and a token in more than ``RARE`` sets becomes frequent.

Verifying without all pairs. Equal sets are one representative from the start. Documents under one signature are compared
with a few hubs of it, equal for all signatures, then what the links join is contracted. A signature whose documents are
in one component is done; of signatures with the same documents one is enough; small ones compare all that is left at once.
After a round of hubs so do the others: every pair of different components under a signature is compared, so no link
that matters is lost, and the pairs inside the large groups are never made. A join makes only pairs that can link by their
sizes and parities, at the least signature that both carry among their first ones: a bit of a set's parities tells whether an odd number of its tokens falls on it, so two sets differ in
at least as many tokens as their parities differ in bits. A few bits decide inside the join; before texts are fetched, each
pair meets parities that are as wide as its sets are large, so texts that share a passage only are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden.llm.tables import components, keep, small_batches
from textwarden.llm.wordstream import BLANK_WORDS, Runs, U, Words, lean, mix, signed, words_in

SHINGLE = 5
PERCENT = 75
#: Counters of the sketch and counters in one of its rows. 4 MB of classes reach every task, whatever the corpus.
COUNTERS, ROW = 1 << 22, 1 << 12
#: Tokens in at most RARE sets are indexed singly, the others in combinations of K of one part.
RARE, K = 8, 2
#: Ranges of set sizes (from, below) and their parts. A size counts for every range in which it can have a partner.
RANGES = ((0, 32, 1), (32, 1024, 16), (1024, 1 << 31, 128))
#: Bits of the filter that keeps texts without a candidate out of the shuffle (2 MB, whatever the corpus).
FILTER_BITS = 1 << 24
#: Numbers of 64 parity bits that describe a set.
PARITIES = 8
#: Rounds with hubs before the rest is compared pair by pair.
ROUNDS = 1
HUBS = 4
#: Signatures of at most this many documents are compared pair by pair at once.
SMALL = 16
#: Bytes of text whose words are worked on at once; a longer text is taken alone.
PIECE = 1 << 18
#: Least signatures that a document's rows carry, so that a pair that shares many signatures is made at one of them.
FIRST = 16
#: Texts in one task of a hub's comparisons.
FAN = 2000


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of each document's distinct shingles, sorted by both. Fewer than k words make one token."""
    hashes, doc = words.hashes(), words.of_word()
    runs = Runs(hashes)
    full = np.flatnonzero(words.room() >= k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    ends = words.bounds[1:][short]
    token = np.r_[runs.all(k)[full], mix(runs.at(words.bounds[:-1][short], ends) ^ U(0x5851F42D4C957F2D))]
    of = np.r_[doc[full], short]
    order = np.lexsort((token, of))
    of, token = of[order], token[order]
    fresh = np.r_[True, (of[1:] != of[:-1]) | (token[1:] != token[:-1])] if len(of) else np.zeros(0, dtype=bool)
    return of[fresh], token[fresh]


def _need(n, percent: int):
    """Tokens of a prefix that must count: one more than a partner may lack."""
    return n - (percent * n + 99) // 100 + 1


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that sets of n can need for their prefixes in the worst case."""
    parts = np.max([np.where((n * 100 >= low * percent) & (n < high), p, 0) for low, high, p in RANGES], axis=0)
    return np.minimum(n, _need(n, percent) + (K - 1) * parts)


def _slot(token: np.ndarray) -> np.ndarray:
    return (token >> U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _count(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int32)
        for batch in batches:
            for _, _, words in words_in(batch.column(0), BLANK_WORDS, True, PIECE):
                np.add.at(counts, _slot(shingle_sets(words, k)[1]), 1)
        if counts.any():
            small = counts.astype("<u2") if counts.max() <= 0xFFFF else counts.astype("<u8")
            rows = small.reshape(-1, ROW)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "counts"])

    return lean(work)


@lean
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the tasks' counters row by row, streaming: one array for each row of the sketch that this task owns."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[row] = held.get(row, 0) + np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * ROW else "<u8").astype(np.int64)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in held.values()], pa.binary())], ["row", "counts"])


def frequency_classes(texts: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Class of every counter: 0 up to a count that chance and ``RARE`` sets explain, one more for each doubling. A text column of any table."""
    added = texts.mapInArrow(_count(k), "row int, counts binary").repartition("row").mapInArrow(_add, "row int, counts binary")
    counts = np.zeros((COUNTERS // ROW, ROW), dtype=np.int64)
    for row, blob in added.collect():  # COUNTERS numbers, however large the corpus
        counts[row] = np.frombuffer(blob, dtype="<i8")
    flat = counts.reshape(-1)
    usual = flat.mean() + 4 * np.sqrt(flat.mean()) + RARE
    return np.clip(np.floor(np.log2(np.maximum(flat, 1) / usual)) + 1, 0, 60).astype(np.uint8)


def _keys(of: np.ndarray, token: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document the first token's place, the size and the identity of its set."""
    n = np.bincount(of, minlength=docs)
    bounds = np.r_[0, np.cumsum(n)]
    sums = np.r_[U(0), np.cumsum(mix(token ^ U(0x1B873593)))]
    return bounds, n, signed(mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(n.astype(U) + U(1))))


def parities(of: np.ndarray, token: np.ndarray, docs: int) -> np.ndarray:
    """``PARITIES`` numbers for each document: the bits on which an odd number of its tokens falls."""
    bits = 64 * PARITIES
    odd = np.bincount(of * bits + (token & U(bits - 1)).astype(np.int64), minlength=docs * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parities(of: np.ndarray, token: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Parities of at least as many bits as a document has tokens: a power of two times 64, ``PARITIES`` times 64 or more."""
    width = np.maximum(PARITIES, 1 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64))
    bounds = np.r_[0, np.cumsum(width)]
    at = bounds[of] * 64 + (token & (width[of] * 64 - 1).astype(U)).astype(np.int64)
    odd = np.zeros(bounds[-1] * 64, dtype=np.uint8)
    np.bitwise_xor.at(odd, at, np.uint8(1))
    return pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(np.packbits(odd).view(np.int64)))


def _describe(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in words_in(batch.column("_text"), BLANK_WORDS, True, PIECE):
                sets = shingle_sets(words, k)
                _, n, key = _keys(*sets, end - row)
                odd = pa.ListArray.from_arrays(np.arange(end - row + 1, dtype=np.int32) * PARITIES, pa.array(parities(*sets, end - row)))
                wide = wide_parities(*sets, n)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(row, end - row), pa.array(key), pa.array(n.astype(np.int32)), odd, wide], ["_id", "key", "n", "odd", "wide"])

    return lean(work)


def _prefixes(classes, k: int, percent: int):
    """(key, n, place, token, frequent) of every token in a prefix, the rarest first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, words in words_in(batch.column(0), BLANK_WORDS, True, PIECE):
                of, token = shingle_sets(words, k)
                bounds, n, key = _keys(of, token, end - row)
                token = token[np.lexsort((token, classes.value[_slot(token)], of))]
                place = np.arange(len(token)) - bounds[of]
                used = place < prefix_length(n, percent)[of]
                token, place, of = token[used], place[used].astype(np.int32), of[used]
                yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(n[of].astype(np.int32)), pa.array(place), pa.array(signed(token)), pa.array(classes.value[_slot(token)] > 0)], ["key", "n", "place", "token", "frequent"])

    return lean(work)


@lean
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Out of rows sorted by token and set: those of tokens in two sets or more, and whether these are more than ``RARE``.

    Of a token whose rows may go on in the next batch, ``RARE`` + 1 rows are held back at most.
    """
    names = ["token", "key", "n", "place"]
    held = {c: np.zeros(0, dtype=np.int64) for c in names}
    for batch in _ending(batches):
        now = {c: np.r_[held[c], batch.column(c).to_numpy()] for c in names} if batch is not None else held
        if not len(now["token"]):
            continue
        fresh = np.r_[True, (now["token"][1:] != now["token"][:-1]) | (now["key"][1:] != now["key"][:-1])]
        now = {c: v[fresh] for c, v in now.items()}
        first = np.flatnonzero(np.r_[True, now["token"][1:] != now["token"][:-1]])
        size = np.diff(np.r_[first, len(now["token"])])
        df = np.repeat(size, size)
        out = df > 1
        keep_from = len(df)
        if batch is not None:
            keep_from = max(first[-1], len(df) - RARE - 1)
            out &= (np.arange(len(df)) < first[-1]) | (df > RARE) & (np.arange(len(df)) < keep_from)
        held = {c: v[keep_from:] for c, v in now.items()}
        yield pa.RecordBatch.from_arrays([pa.array(now["key"][out]), pa.array(now["n"][out].astype(np.int32)), pa.array(now["place"][out].astype(np.int32)), pa.array(now["token"][out]), pa.array(df[out] > RARE)], ["key", "n", "place", "token", "frequent"])


def _ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


@cache
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64).reshape(-1, k)


def _combined(tokens: np.ndarray, k: int, parts: int) -> Iterator[np.ndarray]:
    """One hash for each k tokens (sorted) that lie in one part."""
    part = (tokens & U(parts - 1)).astype(np.int64)
    for p in np.flatnonzero(np.bincount(part, minlength=parts) >= k):
        own = tokens[part == p]
        chosen = own[_choices(len(own), k)]
        h = np.full(len(chosen), (k << 8) + parts, dtype=U)
        for i in range(k):
            h = mix(h ^ chosen[:, i])
        yield h


def _least_prefix(part: np.ndarray, need: int) -> int:
    """Tokens up to where those that count come to ``need``: rare ones (part -1), and each part's beyond the first K - 1."""
    order = np.argsort(part, kind="stable")
    first = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1]
    rank = np.empty(len(part), dtype=np.int64)
    rank[order] = np.arange(len(part)) - np.repeat(first, np.diff(np.r_[first, len(part)]))
    counted = np.cumsum((part < 0) | (rank >= K - 1))
    return int(np.searchsorted(counted, need)) + 1


def _index(percent: int):
    """Signatures of a document: rare tokens and combinations of frequent ones in its least prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, shared) in enumerate(zip(batch.column("n").to_pylist(), batch.column("shared"), strict=True)):
                place, token, often = (shared.values.field(f).to_numpy(zero_copy_only=False) for f in ("place", "token", "frequent"))
                length = int(prefix_length(np.array([n]), percent)[0])
                tokens, known, frequent = np.zeros(length, dtype=U), np.zeros(length, dtype=bool), np.zeros(length, dtype=bool)
                tokens[place], known[place], frequent[place] = token.view(U), True, often
                sigs = [np.zeros(0, dtype=U)]
                for low, high, parts in RANGES:
                    if n * 100 >= low * percent and n < high:
                        part = np.where(frequent, (tokens & U(parts - 1)).astype(np.int64), -1)
                        end = _least_prefix(part, _need(n, percent))
                        own, often = tokens[:end], frequent[:end]
                        sigs.append(own[known[:end] & ~often])
                        sigs += _combined(np.sort(own[often]), K, parts)
                sig = signed(np.unique(np.concatenate(sigs)))
                if len(sig):
                    yield pa.RecordBatch.from_arrays([pa.array(sig), *(pa.repeat(batch.column(c)[i], len(sig)) for c in ("key", "n"))], ["sig", "key", "n"])

    return lean(work)


def signatures(texts: DataFrame, classes, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(sig, key, n) of every set that can have a partner; signatures of one set only are left out."""
    tokens = texts.mapInArrow(_prefixes(classes, k, percent), "key long, n int, place int, token long, frequent boolean")
    kind = "key long, n int, place int, token long, frequent boolean"
    dealt = tokens.where("not frequent").select("token", "key", "n", "place").repartition("token").sortWithinPartitions("token", "key")
    known = dealt.mapInArrow(_shared, kind).unionByName(tokens.where("frequent"))
    shared = known.groupBy("key", "n").agg(F.collect_set(F.struct("place", "token", "frequent")).alias("shared"))
    sigs = keep(shared.mapInArrow(_index(percent), "sig long, key long, n int"), "index")
    again = keep(sigs.groupBy("sig").count().where("count > 1").select("sig"), "shared-signatures")
    return sigs.join(again, "sig")


def _verify(k: int, percent: int):
    """Rows sorted by hub, the hub's own text first; each other row's set is compared with it as it passes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for row, end, words in words_in(batch.column("text"), BLANK_WORDS, True, PIECE):
                of, token = shingle_sets(words, k)
                bounds = np.searchsorted(of, np.arange(end - row + 1))
                for i in range(end - row):
                    other, x, y = token[bounds[i] : bounds[i + 1]], a[row + i], b[row + i]
                    if y is None:
                        now, own = x, other
                    elif x == now:
                        shared = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(other) - shared):
                            out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return lean(work)


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity. a's text goes to every part of its partners, b's to its row."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    hubs = fans.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1)).alias("fan"))
    hubs = hubs.join(texts.withColumnRenamed("rep", "a"), "a").select("a", "fan", F.lit(None).cast("long").alias("b"), "text")
    rows = pairs.join(fans, "a").withColumn("fan", F.pmod(F.xxhash64("b"), "fans")).join(texts.withColumnRenamed("rep", "b"), "b").select("a", "fan", "b", "text")
    dealt = hubs.unionByName(rows).repartition("a", "fan").sortWithinPartitions("a", "fan", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_verify(k, percent), "a long, b long")


def _filter(bits):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            yield batch.filter(pa.array((bits.value[at >> 6] >> (at & 63).astype(U)) & U(1) == 1))

    return lean(work)


def _matching(k: int):
    """(rep, text) of the rows whose set is the asked one; repeated rows pass once in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for row, end, words in words_in(batch.column("text"), BLANK_WORDS, True, PIECE):
                _, _, key = _keys(*shingle_sets(words, k), end - row)
                rep, asked = (batch.column(c).slice(row, end - row).to_numpy() for c in ("rep", "key"))
                fits = (key == asked) & np.r_[rep[:1] != last, rep[1:] != rep[:-1]]
                last = rep[-1]
                part = batch.slice(row, end - row).filter(pa.array(fits))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("text")], ["rep", "text"])

    return lean(work)


def _texts_of(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(rep, text) of the asked (rep, key); a bit filter of fixed size keeps most other texts out of the shuffle."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = asked.select(bit("rep").alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=U)
    bits[words.column("at").to_numpy()] = words.column("word").to_numpy().view(U)
    some = rows.where("_id is not null").select(F.col("_id").alias("rep"), F.col("_text").alias("text"), bit("_id").alias("bit"))
    some = some.mapInArrow(_filter(rows.sparkSession.sparkContext.broadcast(bits)), some.schema).drop("bit")
    return some.join(asked, "rep").select("rep", "key", "text").mapInArrow(_matching(k), "rep long, text string")


def _alike(left: str, right: str, percent: int):
    return (F.least(left, right) * 100 >= F.greatest(left, right) * percent)


def _near(left: str, right: str, size_left: str, size_right: str, percent: int):
    """Whether sets of these parities and sizes can link: they may differ in (100 - percent) / (100 + percent) of both sizes."""
    apart = sum((F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(PARITIES)), F.lit(0))
    return apart * (100 + percent) <= (F.col(size_left) + F.col(size_right)) * (100 - percent)


def _wide_enough(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their wide parities allow. Parities of twice the other's width are folded to it first."""
    for side, s in (("a", "1"), ("b", "2")):
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("n").alias("n" + s), F.col("wide").alias("wide" + s)), side)

    def folded(own: str, other: str):
        half = F.call_function("div", F.size(own), F.lit(2)).cast("int")
        halves = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) == 2 * F.size(other), halves).otherwise(F.col(own))

    bits = F.zip_with(folded("wide1", "wide2"), folded("wide2", "wide1"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    return pairs.where(F.coalesce(apart * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent), F.lit(True))).select("a", "b")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows (sig, rep, comp, n, odd) under one signature that can link, most of them once.

    Every row carries its document's ``FIRST`` least signatures. A pair passes under a signature unless both carry a smaller one,
    under which they meet as well; so it always passes under the least signature that it shares.
    """
    own = Window.partitionBy("rep")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("sig"))).withColumn("first", F.collect_list(F.when(F.col("place") <= FIRST, F.col("sig"))).over(own))
    left, right = (rows.select("sig", *(F.col(c).alias(c + s) for c in ("rep", "comp", "n", "odd", "first"))) for s in "12")
    earlier = F.coalesce(F.array_min(F.array_intersect("first1", "first2")) < F.col("sig"), F.lit(False))
    can = (F.col("rep1") < F.col("rep2")) & (F.col("comp1") != F.col("comp2")) & _alike("n1", "n2", percent) & _near("odd1", "odd2", "n1", "n2", percent)
    return left.join(right, "sig").where(can & ~earlier).select(F.col("rep1").alias("a"), F.col("rep2").alias("b"))


def link_components(sigs: DataFrame, sets: DataFrame, texts_of, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(rep, component) of representatives (sig, rep, n) that links join.

    ``sets`` has (rep, n, odd, wide), sizes and parities of the representatives; ``texts_of(reps)`` gives (rep, text) of given ones.
    """
    spark: SparkSession = sigs.sparkSession
    open_sigs = sigs.withColumn("comp", F.col("rep"))
    roots = None
    for turn in count():
        at_once = F.lit(turn == ROUNDS) | (F.col("size") <= SMALL)
        spread = open_sigs.groupBy("sig").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("members"))
        spread = spread.where("low <> high").dropDuplicates(["size", "members"]).select("sig", "size")
        live = keep(open_sigs.join(keep(spread, "open-signatures"), "sig"), "live-signatures")
        if live.isEmpty():
            break
        near = _met(live.where(at_once).select("sig", "rep", "comp", "n").join(sets.select("rep", "odd"), "rep"), percent)
        large = live.where(~at_once).select("sig", "rep", "comp", "n")
        hubs = F.array_distinct(F.array(*(F.min_by(F.struct("rep", "comp", "n"), F.xxhash64("rep", F.lit(i))) for i in range(HUBS))))
        large = large.join(keep(large.groupBy("sig").agg(hubs.alias("hubs")), "hubs"), "sig")
        met = large.select("rep", "comp", "n", F.explode("hubs").alias("hub")).where((F.col("comp") != F.col("hub.comp")) & _alike("n", "hub.n", percent)).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))
        pairs = keep(_wide_enough(near.unionByName(met).distinct(), sets, percent), "pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        links = keep(_links(pairs, keep(texts_of(asked), "candidate-texts"), k, percent), "links")
        known = links if roots is None else links.unionByName(roots.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        roots = components(known).select(F.col("node").alias("rep"), F.col("root"))
        if turn == ROUNDS:
            break
        rest = large.where(~F.exists("hubs", lambda h: h["rep"] == F.col("rep"))).select("sig", "rep", "n")
        open_sigs = keep(rest.join(roots, "rep", "left").select("sig", "rep", "n", F.coalesce("root", "rep").alias("comp")), "signatures")
    if roots is None:
        return spark.createDataFrame([], "rep long, component long")
    return roots.withColumnRenamed("root", "component")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: the id, n_shingles (distinct k-word shingles) and component_id, the smallest id that links reach.

    Two documents link when the shared part of their sets is at least ``percent`` of the union. Words are lower-cased (A-Z) and
    split at ASCII blanks; fewer than k words are one shingle. Null, empty and blank texts have size 0 and link with nothing. A
    null id keeps its row and size; it takes no part in links, its component is null. Repeated rows stay rows; rows of
    one id count as one document in links. Other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    known = rows.where("_id is not null and _text is not null")
    with small_batches(spark):
        classes = spark.sparkContext.broadcast(frequency_classes(known.select("_text"), k))
        described = keep(rows.mapInArrow(_describe(k), "_id long, key long, n int, odd array<long>, wide array<long>"), "sets")
        first = F.min_by(F.struct(F.col("_id").alias("rep"), "n", "odd", "wide"), "_id")
        sets = keep(described.where("n > 0 and _id is not null").groupBy("key").agg(first.alias("set")).select("key", "set.*"), "representatives")
        reps = sets.select("key", "rep")
        sigs = keep(signatures(known.select("_text"), classes, k, percent).join(reps, "key").select("sig", "rep", "n"), "signatures")
        linked = link_components(sigs, sets.drop("key"), lambda ids: _texts_of(rows, ids.join(reps, "rep"), k), k, percent)
    named = reps.join(linked, "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    own = described.select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "key", ((F.col("n") == 0) | F.col("_id").isNull()).alias("alone"))
    return own.join(named, "key", "left").select(id_col, "n_shingles", F.when(F.col("alone"), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))
