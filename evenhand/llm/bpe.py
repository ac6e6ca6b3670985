"""Byte-level BPE on the JVM: higher-order functions fold ranked merges over the bytes of words.

A rank map is a literal: a sparse table of left by right tokens, its rows shifted into one array. The fold keeps a
word's token ids and its adjacent pairs' ranks, and each step merges the leftmost pair of least rank; long words
are folded in blocks that are joined exactly. The most frequent distinct words of a sample of the texts are folded once and
become a second literal of bounded size; every other word is folded where it stands, so bound and sample change speed only.
Decoding looks up each id's bytes and concatenates the pieces.
"""

from __future__ import annotations

import base64
import copy
import functools
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct words in the literal at most.
KNOWN_WORDS = 1 << 19
#: One in so many texts is counted, by its hash, to find the frequent words.
COUNTED = 2
#: Longer words are folded in blocks of this many bytes, since a fold is quadratic in its bytes.
BLOCK = 256
#: An entry's bits: 17 for an id, 28 for a place, 18 for a rank.
_ID_BITS, _RANK_AT = 17, 45
_NO_ID, _NO_RANK = (1 << 17) - 1, 1 << 17


def pattern(text_pattern: str) -> str:
    """The split pattern for Java: white space as Unicode has it."""
    return "(?U)" + text_pattern


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every split of a token into two tokens -> its rank: exactly the merges that can occur."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def displacements(firsts: np.ndarray, groups: np.ndarray, n_groups: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A perfect hash: shifts so that first + shift of group differ for all keys, and which keys it places.

    Keys of one group that share a first place can't be told apart: the earlier one stays. Places end below 2 * size.
    """
    kept = np.zeros(len(firsts), bool)
    kept[np.unique(firsts * n_groups + groups, return_index=True)[1]] = True
    at = np.flatnonzero(kept)
    order = at[np.argsort(groups[at], kind="stable")]
    cuts = np.searchsorted(groups[order], np.arange(n_groups + 1)).tolist()
    counts = np.diff(cuts)
    taken, shifts, firsts = bytearray(2 * size), np.zeros(n_groups, np.int64), firsts[order].tolist()
    for g in np.argsort(-counts, kind="stable").tolist():
        own = firsts[cuts[g] : cuts[g + 1]]
        if not own:
            break
        d = 0
        while any(taken[f + d] for f in own):
            d = taken.index(0, own[0] + d + 1) - own[0]
        for f in own:
            taken[f + d] = 1
        shifts[g] = d
    return shifts, kept


def row_shifts(columns: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """A sparse table's rows in one array: shifts so that column + shift of row differ for all cells. Cells are distinct."""
    order = np.argsort(rows, kind="stable")
    cuts = np.searchsorted(rows[order], np.arange(n_rows + 1)).tolist()
    counts, columns = np.diff(cuts), columns[order]
    taken, shifts, least = np.zeros(2 * len(columns) + 1, bool), np.zeros(n_rows, np.int64), {}
    for row in np.argsort(-counts, kind="stable").tolist():
        own = columns[cuts[row] : cuts[row + 1]].tolist()
        if not own:
            break
        # rows of like size start where the last one was placed
        d, block = least.get(len(own).bit_length(), 0), 64
        while True:
            if (more := max(own) + d + block - len(taken)) > 0:
                taken = np.concatenate([taken, np.zeros(more + len(taken), bool)])
            used = np.logical_or.reduce([taken[c + d : c + d + block] for c in own])
            if not used.all():
                break
            d, block = d + block, min(4096, 2 * block)
        d += int(used.argmin())
        taken[np.array(own) + d] = True
        shifts[row] = least[len(own).bit_length()] = d
    return shifts


def _literal(spark: SparkSession, words: np.ndarray, kind: str) -> Column:
    """64-bit words in Spark's binary array format as a literal of the type `kind`.

    They reach the JVM piece by piece, so that the driver never holds them as texts or boxed values.
    """
    jvm, nio = spark._jvm.org.apache.spark, spark._jvm.java.nio
    held = spark.sparkContext._gateway.new_array(spark._jvm.long, len(words))
    for at in range(0, len(words), 1 << 17):
        part = words[at : at + (1 << 17)].astype("<i8")
        nio.ByteBuffer.wrap(part.tobytes()).order(nio.ByteOrder.LITTLE_ENDIAN).asLongBuffer().get(held, at, len(part))
    data = jvm.sql.catalyst.expressions.UnsafeArrayData()
    data.pointTo(held, jvm.unsafe.Platform.LONG_ARRAY_OFFSET, 8 * len(words))
    expression = jvm.sql.catalyst.expressions.Literal.create(data, jvm.sql.types.DataType.fromDDL(kind))
    return Column(jvm.sql.classic.ExpressionUtils.column(expression))


def _array(values: np.ndarray) -> np.ndarray:
    """The binary format of array<bigint>: the size, a bit for each null, the values."""
    return np.concatenate(([len(values)], np.zeros(-(-len(values) // 64), np.int64), values)).astype(np.int64)


def _placed(sizes: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The binary format of an array of elements that take `filled` 64-bit words and `sizes` bytes of these; where each begins."""
    head = 1 - (-len(sizes) // 64) + len(sizes)
    begins = head + np.cumsum(filled) - filled
    out = np.zeros(head + int(filled.sum()), np.int64)
    out[: head] = _array(begins << 35 | sizes)
    return out, begins


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _longs(spark: SparkSession, values: np.ndarray) -> Column:
    return _literal(spark, _array(np.asarray(values, np.int64)), "array<bigint>")


def _packed(values: np.ndarray) -> np.ndarray:
    """32-bit values, two to a 64-bit word."""
    return np.concatenate([values, np.zeros(len(values) % 2, np.int64)]).astype("<i4").view(np.int64)


def _ints(spark: SparkSession, values: np.ndarray) -> Column:
    head = _array(np.zeros(len(values), np.int64))[: 1 - (-len(values) // 64)]
    return _literal(spark, np.concatenate([head, _packed(values)]), "array<int>")


def _strings(spark: SparkSession, texts: pa.Array) -> Column:
    ends = pc.cumulative_sum(pc.binary_length(texts).cast(pa.int64())).to_numpy(zero_copy_only=False)
    sizes = np.diff(ends, prepend=0)
    out, begins = _placed(sizes, (sizes + 7) // 8)
    if len(sizes) and ends[-1]:
        first = texts.cast(pa.large_binary())
        start = int(np.frombuffer(first.buffers()[1], np.int64, 1, 8 * first.offset)[0])
        out.view(np.uint8)[np.repeat(8 * begins, sizes) + _ranges(sizes)] = np.frombuffer(first.buffers()[2], np.uint8, int(ends[-1]), start)
    return _literal(spark, out, "array<string>")


def _lists(spark: SparkSession, values: np.ndarray, sizes: np.ndarray) -> Column:
    """Lists of `sizes` values each, one after another, as array<array<int>>."""
    head = 1 + (sizes + 63) // 64
    filled = head + (sizes + 1) // 2
    out, begins = _placed(8 * filled, filled)
    out[begins] = sizes
    out.view("<i4")[np.repeat(2 * (begins + head), sizes) + _ranges(sizes)] = values
    return _literal(spark, out, "array<array<int>>")


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _held(literals: dict[str, Column], body) -> Column:
    """body(fields) where each literal stands in the plan once.

    Spark hashes all bytes of a literal wherever it occurs, in the driver for every step of planning and again for each task.
    """
    return _let(F.struct(*[value.alias(name) for name, value in literals.items()]), body)


def _prime(least: int) -> int:
    return next(n for n in range(max(3, least) | 1, 2 * least + 9, 2) if all(n % d for d in range(3, int(n**0.5) + 1, 2)))


class RankMap:
    """The pair ranks as literal columns, a sparse table, and the fold of a word's merges by them.

    An entry of the fold packs the rank of a token and its right neighbour, the token's place (a byte offset)
    and its id, so that an array's minimum is the leftmost pair of least rank. A pair without a rank has _NO_RANK.
    """

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        pairs = pair_ranks(ranks)
        left, right = np.array(list(pairs), np.int64).reshape(-1, 2).T
        assert max(ranks.values()) < _NO_ID, "ids take 17 bits"
        shifts = row_shifts(right, left, max(ranks.values()) + 1)
        slots = right + shifts[left]
        found = np.full(slots.max(initial=-1) + 1, -1, np.int64)
        found[slots] = left << _ID_BITS | np.fromiter(pairs.values(), np.int64, len(pairs))
        self.literals = {"shifts": _longs(spark, shifts), "found": _longs(spark, found)}
        byte_ids = [ranks[bytes([b])] for b in range(256)]
        starts = np.full((256, 257), _NO_RANK << _RANK_AT, np.int64)
        for a in range(256):
            for b in range(256):
                if (r := pairs.get((byte_ids[a], byte_ids[b]))) is not None:
                    starts[a, b] = r << _RANK_AT
        self.literals["starts"] = _longs(spark, (starts + np.array(byte_ids)[:, None]).ravel())

    def held(self, fields: Column) -> RankMap:
        """This map over the fields of _held(literals), for use in its body."""
        out = copy.copy(self)
        out.shifts, out.found, out.starts = (fields[name] for name in ("shifts", "found", "starts"))
        return out

    def entry(self, token: Column, right: Column, placed: Column) -> Column:
        """The entry of a token, given with its place as `placed`, and its right neighbour, null for none.

        A slot that holds a pair of this token gives its rank when the token is masked out, another one a larger number.
        """
        slot = F.get(self.shifts, token) + right
        rank = F.least(F.get(self.found, slot).bitwiseXOR(F.shiftleft(token, _ID_BITS)).bitwiseAND(_long(2**63 - 1)), _long(_NO_RANK))
        return F.shiftleft(rank, _RANK_AT).bitwiseOR(placed)

    def merged(self, codes: Column, offset: Column) -> Column:
        """Entries of the tokens of bytes given as numbers; places count from `offset`."""
        def start(x: Column, i: Column) -> Column:
            after = F.coalesce(F.get(codes, i + 1), F.lit(256))
            return F.get(self.starts, x * 257 + after) + F.shiftleft(i.cast("long") + offset, _ID_BITS)

        id_of = lambda e: e.bitwiseAND(_long(_NO_ID))
        placed = lambda e: e.bitwiseAND(_long((1 << _RANK_AT) - 1))
        place = lambda e: e.bitwiseAND(_long((1 << _RANK_AT) - 1 - _NO_ID))

        def step(now: Column, _) -> Column:
            def merge(least: Column) -> Column:
                token = F.shiftright(least, _RANK_AT)

                def changed(e: Column, i: Column) -> Column:
                    grown = self.entry(token, id_of(F.get(now, i + 2)), place(least).bitwiseOR(token))
                    before = self.entry(id_of(e), token, placed(e))
                    return F.when(e == least, grown).when(F.get(now, i + 1) == least, before).otherwise(e)

                right = F.get(now, F.array_position(now, least).cast("int"))
                return F.when(least < _long(_NO_RANK << _RANK_AT), F.array_remove(F.transform(now, changed), right)).otherwise(now)

            return _let(F.array_min(now), merge)

        steps = F.sequence(F.lit(2), F.greatest(F.size(codes), F.lit(2)))
        return F.aggregate(steps, F.transform(codes, start), step)

    def entries(self, word: Column) -> Column:
        """Entries of a word of any length: blocks are folded apart and joined where that can't change their tokens.

        Tokens are those of the whole word if every two neighbours are what their own bytes fold to. So the
        bytes around a joint are folded anew, and the result holds if its ends are the tokens that stood there;
        where they aren't, more bytes are taken, and in the end all.
        """
        place = lambda e: F.shiftright(e.bitwiseAND(_long((1 << _RANK_AT) - 1)), _ID_BITS)
        same = lambda e: e.bitwiseAND(_long((1 << _RANK_AT) - 1))

        def folded(codes: Column) -> Column:
            part = lambda a, b: F.slice(codes, a.cast("int") + 1, (b - a).cast("int"))
            size = F.size(codes)

            def join(left: Column, at: Column) -> Column:
                end = F.least(at + BLOCK, size)

                def with_right(right: Column) -> Column:
                    def window(k: int, otherwise: Column) -> Column:
                        first, after = F.get(left, F.greatest(F.size(left) - k, F.lit(0))), F.get(right, F.lit(k))
                        last = F.get(right, F.least(F.lit(k), F.size(right)) - 1)
                        stop = F.coalesce(place(after), end.cast("long"))

                        def check(mid: Column) -> Column:
                            ok_left = (F.size(left) <= k) | (same(F.get(mid, F.lit(0))) == same(first))
                            ok_right = (F.size(right) <= k) | (same(F.get(mid, F.size(mid) - 1)) == same(last))
                            parts = F.concat(F.slice(left, F.lit(1), F.greatest(F.size(left) - k, F.lit(0))), mid, F.slice(right, F.lit(k + 1), F.size(right)))
                            return F.when(ok_left & ok_right, parts).otherwise(otherwise)

                        return _let(self.merged(part(place(first), stop), place(first)), check)

                    return window(16, window(128, self.merged(part(_long(0), end), _long(0))))

                return _let(self.merged(part(at, end), at.cast("long")), with_right)

            whole = self.merged(codes, _long(0))
            blocks = F.aggregate(F.sequence(F.lit(BLOCK), size - 1, F.lit(BLOCK)), self.merged(part(F.lit(0), F.lit(BLOCK)), _long(0)), join)
            return F.when(size <= 2 * BLOCK, whole).otherwise(blocks)

        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        return _let(F.transform(chars, F.ascii), folded)

    def fold(self, word: Column) -> Column:
        """array<bigint> of the ids of a word."""
        return _held(self.literals, lambda fields: self.held(fields).folded(word))

    def folded(self, word: Column) -> Column:
        """As fold(), of a map that is held."""
        return F.transform(self.entries(word), lambda e: e.bitwiseAND(_long(_NO_ID)))


class WordMap:
    """Encoded words as literal columns, by a perfect hash of xxhash64; the words that come first lie together."""

    def __init__(self, spark: SparkSession, words: pa.Array, ids: pa.Array):
        """ids: each word's ids, a list."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer(), seed=42) for w in words), np.uint64, len(words)).astype(np.int64)
        size = 1 << max(4, int(len(words) * 1.3).bit_length())
        n_groups = max(1, size // 8)
        firsts, groups = hashes & (size - 1), (hashes >> 40) & (n_groups - 1)
        shifts, kept = displacements(firsts, groups, n_groups, size)  # a word it can't place is folded where it stands
        row_at = np.full(2 * size, -1, np.int64)
        row_at[(firsts + shifts[groups])[kept]] = np.flatnonzero(kept)
        row_at = row_at[: int(np.flatnonzero(row_at >= 0).max(initial=0)) + 1]
        self.size, self.n_groups = size, n_groups
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.literals = {
            "word_shifts": _longs(spark, shifts), "rows": _ints(spark, row_at), "words": _strings(spark, words),
            "ids": _lists(spark, ids.flatten().to_numpy(zero_copy_only=False), sizes),
        }

    def ids_or(self, fields: Column, words: Column, other) -> Column:
        """array<array<int>>: the ids of each of `words`, other(word) where the literal doesn't hold it; in the body of _held(literals)."""
        def row(w: Column) -> Column:
            h = F.xxhash64(w)  # hashing a word twice takes less than holding its hash
            slot = h.bitwiseAND(_long(self.size - 1)) + F.get(fields["word_shifts"], F.shiftright(h, 40).bitwiseAND(_long(self.n_groups - 1)))
            return F.get(fields["rows"], slot)

        def ids(r: Column, i: Column) -> Column:
            return F.when(F.get(fields["words"], r).eqNullSafe(F.get(words, i)), F.get(fields["ids"], r)).otherwise(other(F.get(words, i)).cast("array<int>"))

        return F.transform(F.transform(words, row), ids)


def split_words(text: Column, text_pattern: str = public_tokenizers.PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(text_pattern)), F.lit(0))


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """Of rows with an array `words`: the distinct words above the least count that leaves `most` at most, and their counts `n`."""
    counted = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted.filter((F.octet_length("word") <= BLOCK) & (F.col("n") > 1)), "bpe-words")
    # as many rows as there are different counts below `most`, and one
    by_count = counted.groupBy(F.least("n", F.lit(most)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    held, least = 0, most + 1
    for n, k in by_count:
        if held + k > most:
            break
        held, least = held + k, n
    return counted.filter(F.col("n") >= least)


def encoded(docs: DataFrame, path: str, known_words: int = KNOWN_WORDS) -> DataFrame:
    """doc_id and ids array<int> of every whole text, without special tokens.

    Null texts are empty and have no ids; null ids and repeated rows are encoded as any other; texts and words may
    have any length; an empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    ranks = RankMap(spark, load_ranks(path))
    split = lambda rows: rows.select(F.col("doc_id").cast("long").alias("doc_id"), split_words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    known = frequent_words(split(docs.filter(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)), known_words)
    release(spark)
    rows = known.select("word", ranks.fold(F.col("word")).alias("ids"), "n").toArrow()  # at most known_words rows
    rows = rows.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    words = WordMap(spark, *(rows.column(name).combine_chunks() for name in ("word", "ids")))
    del rows
    pa.default_memory_pool().release_unused()
    release(spark)
    ids = lambda fields: words.ids_or(fields, F.col("words"), ranks.held(fields).folded)
    return split(docs).select("doc_id", F.flatten(_held(ranks.literals | words.literals, ids)).alias("ids"))


def id_bytes(spark: SparkSession, ids: Column, vocabulary: int) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""
    texts = _strings(spark, pa.array([i.to_bytes(4, "little").hex() for i in range(vocabulary)]))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(texts, i)), ""))


def decoded(spark: SparkSession, ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids: pieces looked up and concatenated."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token.hex()
    texts = _strings(spark, pa.array(pieces))
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(texts, i)), ""))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs. Nulls, repeated rows, long words and empty tables as in encoded()."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")  # the literals would fill logs
    ranks = load_ranks(path)
    ids = F.col("ids")
    return encoded(docs, path).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(id_bytes(spark, ids, max(ranks.values()) + 1), 256).alias("ids_sha256"), F.sha2(decoded(spark, ids, ranks), 256).alias("decoded_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the digests of each document of the mix, a row for each time it was taken. Edge cases as in digests()."""
    return digests(docs, public_tokenizers.path(RANKS))
