"""Byte-level BPE of a whole corpus inside the JVM: ranked merges folded with higher-order functions.

A text is cut into words by the tokenizer's pattern. A word that is a token is looked up; others are
turned into byte arrays and cut between two bytes that stand together in no token, since no merge
can cross there. Of each piece a fold merges the adjacent pair of lowest rank until none is left, as
the vocabulary's merge list says. All lookups go against literals: the merge ranks, the whole tokens
and the pairs of bytes, as arrays (of small maps addressed by a hash, since Spark searches one large
map from its start). ``learnt`` adds the commonest distinct other words and pieces of a bounded
sample, folded once, to the known tokens; which those are changes the work only, never the ids.
Words in no table are hardly ever repeated within a text, so they are folded where they stand.

No shuffle and no Python but for the bounded sample; the work is in proportion to the text,
whatever its words are. A piece of more than ``WINDOW`` bytes, for which one fold over all pairs would be
quadratic, is folded window by window: the ids so far stay but for the last few, which are folded
again with the next window's bytes.
"""

from __future__ import annotations

import copy
import json
import os
import zlib
from dataclasses import dataclass
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of Unicode, as the tokenizer's pattern means it (fixed values).
SPACE = r"\t-\r \x85\xA0  -     　"
#: The pattern of the byte-level vocabulary (fixed value), with white space spelt out.
PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?(?:\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+)|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
TOKENIZERS = "/opt/tokenizers"
BUCKETS = 32749
WINDOW, TAIL = 256, 16
NEVER = (1 << 17) - 1
TOKEN_BITS, PLACE_BITS = 17, 28


@dataclass(frozen=True)
class Vocabulary:
    """Tokens as bytes, ids of the single bytes, and (left id, right id) -> merged id; a merged id rises with its rank."""

    tokens: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    merges: dict[tuple[int, int], int]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins by which a byte-level vocabulary file spells bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a byte-level BPE file in the tokenizers library's format."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    spelt = _byte_alphabet()
    vocab = {bytes(spelt[c] for c in t): i for t, i in model["vocab"].items() if all(c in spelt for c in t)}
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        tokens[i] = t
    merges, last = {}, -1
    for pair in model["merges"]:
        left, right = (bytes(spelt[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
        made = vocab[left + right]
        if made <= last:
            raise ValueError("ids must rise with the merges' ranks")
        last = made
        merges[vocab[left], vocab[right]] = made
    return Vocabulary(tuple(tokens), tuple(vocab[bytes([b])] for b in range(256)), merges)


def _word_bucket(word: str) -> int:
    """What Spark's ``pmod(xxhash64(word), BUCKETS)`` gives; 42 is its seed."""
    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def _buckets(entries: dict, bucket) -> list[dict]:
    cells: list[dict] = [{"k": [], "v": []} for _ in range(BUCKETS)]
    for k, i in entries.items():
        at = cells[bucket(k)]
        at["k"].append(k)
        at["v"].append(i)
    return cells


def _literal(spark: SparkSession, name: str, value: list, kind: str, key: tuple[str, str] | None = None) -> Column:
    """A session variable holding ``value``, which the optimizer puts into a plan as one compact literal."""
    read = f"from_json(v, '{kind}')"
    if key:
        read = f"transform(from_json(v, 'array<struct<k:array<{key[0]}>,v:array<{key[1]}>>>'), x -> map_from_arrays(x.k, x.v))"
    spark.createDataFrame([(json.dumps(value, separators=(",", ":")),)], "v string").createOrReplaceTempView(f"{name}_source")
    spark.sql(f"declare or replace variable {name} {kind}")
    spark.sql(f"set variable {name} = (select {read} from {name}_source)")
    spark.catalog.dropTempView(f"{name}_source")
    return F.expr(f"session.{name}")


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


class Encoder:
    """Column expressions that encode and decode with one vocabulary.

    ``path``: a byte-level BPE file of the tokenizers library; it is read on the driver and never
    copied elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.path = path or os.path.join(TOKENIZERS, "byte_bpe_50k.json")
        v = self.vocabulary = load(self.path)
        words = {}
        for i, t in enumerate(v.tokens):
            try:
                words[t.decode("utf-8")] = i
            except UnicodeDecodeError:
                continue  # no word of a text is half a character
        words.pop("", None)
        self._tag = f"slotline_{zlib.crc32(self.path.encode()):08x}"
        self._whole = {w: [i] for w, i in words.items()}
        self._parts = {t.decode("latin-1"): [i] for i, t in enumerate(v.tokens) if t}
        self._words, self._known = self._table(spark, self._whole, "words"), self._table(spark, self._parts, "known")
        self._pairs = self._variable(spark, "pairs", _buckets({a * 65536 + b: i for (a, b), i in v.merges.items()}, lambda k: k % BUCKETS), "array<map<bigint,int>>", ("bigint", "int"))
        together = {a * 256 + b for t in v.tokens for a, b in zip(t, t[1:], strict=False)}
        self._together = self._variable(spark, "together", [k in together for k in range(1 << 16)], "array<boolean>")
        self._bytes = self._variable(spark, "bytes", list(v.byte_ids), "array<int>")
        self._lengths = self._variable(spark, "lengths", [len(t) for t in v.tokens], "array<int>")
        self._pieces = self._variable(spark, "pieces", [t.hex() for t in v.tokens], "array<string>")

    def _variable(self, spark: SparkSession, name: str, value: list, kind: str, key: tuple[str, str] | None = None) -> Column:
        return _literal(spark, f"{self._tag}_{name}", value, kind, key)

    def _table(self, spark: SparkSession, entries: dict[str, list[int]], name: str) -> Column:
        return self._variable(spark, name, _buckets(entries, _word_bucket), "array<map<string,array<int>>>", ("string", "array<int>"))

    def learnt(self, df: DataFrame, text: str = "text", most_texts: int = 2000, most_words: int = 20_000) -> Encoder:
        """This encoder with the ids of common words and pieces that are no tokens at hand, at most ``most_words`` of each.

        They are the commonest of about ``most_texts`` texts (at most twice as many), those of least
        hash; every other word and piece is folded where it stands.
        """
        fine = 1 << 40
        share = min(1.0, most_texts / max(1, df.count()))
        at = F.pmod(F.xxhash64(text), F.lit(fine))
        chosen = df.select(text).filter(at < int(share * fine) + 1).orderBy(at, text).limit(2 * most_texts)

        def common(found: DataFrame, fold) -> dict[str, list[int]]:
            top = found.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(most_words)
            return {r.w: list(r.ids) for r in top.select("w", fold(F.col("w")).alias("ids")).collect()}

        other = chosen.select(F.explode(F.array_distinct(F.filter(self._cut(F.col(text)), lambda w: self._token(w).isNull()))).alias("w"))
        out = copy.copy(self)
        words = common(other.filter(F.octet_length("w") <= WINDOW), self._coded)
        out._words = self._table(df.sparkSession, self._whole | words, "common")
        pieces = other.filter(out._token(F.col("w")).isNull()).select(F.explode(self._crossable(F.col("w"))).alias("w"))
        pieces = common(pieces.filter((F.octet_length("w") <= WINDOW) & self._lookup(self._known, F.col("w")).isNull()), self._fold)
        out._known = self._table(df.sparkSession, self._parts | pieces, "known_common")
        return out

    @staticmethod
    def _cut(text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))

    @staticmethod
    def _lookup(table: Column, word: Column) -> Column:
        return F.element_at(F.get(table, F.pmod(F.xxhash64(word), F.lit(BUCKETS))), word)

    def _token(self, word: Column) -> Column:
        """Ids of a word that is a token or a common word, else NULL."""
        return self._lookup(self._words, word)

    def _ranked(self, left: Column, right: Column) -> Column:
        """Merged id of a pair, which is its rank; ``NEVER`` if the pair is not in the merge list or lacks a side."""
        key = left * 65536 + right
        return F.coalesce(F.element_at(F.get(self._pairs, key % BUCKETS), key).cast("bigint"), F.lit(NEVER))

    def _crossable(self, word: Column) -> Column:
        """The pieces of a word, one letter a byte, cut between bytes that stand together in no token."""

        def cut(latin: Column, codes: Column) -> Column:
            starts = F.filter(F.transform(codes, lambda c, i: F.when(F.get(self._together, F.get(codes, i - 1) * 256 + c), F.lit(None)).otherwise(i + 1)), lambda i: i.isNotNull())
            return _let(starts, lambda s: F.transform(s, lambda at, i: F.substring(latin, at, F.coalesce(F.get(s, i + 1), F.size(codes) + 1) - at)))

        return _let(F.decode(word.cast("binary"), "ISO-8859-1"), lambda latin: _let(F.transform(F.split(latin, ""), F.ascii), lambda codes: cut(latin, codes)))

    def _coded(self, word: Column) -> Column:
        """Ids of a word that is no token: those of its pieces, known or folded."""
        folded = lambda p: F.when(F.length(p) > WINDOW, self._long(p)).otherwise(self._fold(p))
        return F.flatten(F.transform(self._crossable(word), lambda p: F.coalesce(self._lookup(self._known, p), folded(p))))

    def _long(self, piece: Column) -> Column:
        """Ids of a piece of more than ``WINDOW`` bytes, window by window.

        The last ids before a window are folded again with it; if the first of them comes out as it
        was, then all neighbours are those of a valid encoding, and so is the whole. If not, all are
        folded again.
        """

        def step(ids: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(ids, F.greatest(F.size(ids) - TAIL + 1, F.lit(1)), F.lit(TAIL)), F.lit(0), lambda n, t: n + F.get(self._lengths, t))
            again = _let(before, lambda b: self._fold(F.substring(piece, i * WINDOW - b + 1, b + WINDOW)))
            kept = F.greatest(F.size(ids) - TAIL, F.lit(0))
            valid = lambda a: (kept == 0) | (F.get(a, F.lit(0)) == F.get(ids, kept))
            return _let(again, lambda a: F.when(valid(a), F.concat(F.slice(ids, F.lit(1), kept), a)).otherwise(self._fold(F.substring(piece, F.lit(1), (i + 1) * WINDOW))))

        windows = F.sequence(F.lit(1), F.floor((F.length(piece) - 1) / WINDOW).cast("int"))
        return F.aggregate(windows, self._fold(F.substring(piece, F.lit(1), F.lit(WINDOW))), step)

    def _fold(self, piece: Column) -> Column:
        """Ids of a piece: its bytes, merged pair by pair in the order of the ranks.

        The fold's array holds one number a part: rank of the part with its right neighbour, then
        its place, then its id, so that the least number is the pair to merge next.
        """
        start = F.transform(F.split(piece, ""), lambda c: F.get(self._bytes, F.ascii(c)).cast("bigint"))
        pack = lambda rank, place, token: F.shiftleft(rank, TOKEN_BITS + PLACE_BITS) + place + token
        place = lambda x: x.bitwiseAND(F.lit(((1 << PLACE_BITS) - 1) << TOKEN_BITS))
        token = lambda x: x.bitwiseAND(F.lit((1 << TOKEN_BITS) - 1))

        def first(s: Column) -> Column:
            return F.transform(s, lambda t, i: pack(self._ranked(t, F.get(s, i + 1)), F.shiftleft(i.cast("bigint"), TOKEN_BITS), t))

        def step(parts: Column, _: Column) -> Column:
            def merge(least: Column) -> Column:
                def at(i: Column) -> Column:
                    made, after, before = F.shiftright(least, TOKEN_BITS + PLACE_BITS), token(F.get(parts, i + 1)), F.get(parts, i - 2)
                    now = pack(self._ranked(made, after), place(least), made)
                    rest = F.slice(parts, i + 2, F.size(parts))
                    return F.when(i == 1, F.concat(F.array(now), rest)).otherwise(
                        F.concat(F.slice(parts, F.lit(1), i - 2), F.array(pack(self._ranked(token(before), made), place(before), token(before)), now), rest)
                    )

                return F.when(least >= NEVER << (TOKEN_BITS + PLACE_BITS), parts).otherwise(_let(F.array_position(parts, least).cast("int"), at))

            return _let(F.array_min(parts), merge)

        folded = _let(start, lambda s: F.aggregate(F.slice(s, 1, F.size(s) - 1), first(s), step))
        return F.transform(folded, lambda x: token(x).cast("int"))

    def ids(self, text: Column) -> Column:
        """array<int> of a text's token ids; an empty list for NULL and empty texts."""
        return F.flatten(F.transform(self._cut(text), lambda w: F.coalesce(self._token(w), self._coded(w))))

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """Adds ``ids``: array<int> of the text's token ids; an empty list for NULL and empty texts.

        Whole texts of any length; special tokens' strings are ordinary text; repeated rows come out
        as often as they are; other columns are left alone.
        """
        return df.withColumn(ids, self.ids(F.col(text)))

    def decode(self, df: DataFrame, ids: str = "ids", text: str = "text") -> DataFrame:
        """Adds ``text``: the concatenated bytes of the ids, read as UTF-8."""
        binary = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), ""))
        return df.withColumn(text, F.decode(binary, "UTF-8"))


def encoder(spark: SparkSession, path: str | None = None) -> Encoder:
    """The session's encoder, made once: its literals live as long as the session."""
    known = getattr(spark, "_slotline_encoders", None)
    if known is None:
        known = spark._slotline_encoders = {}
    if path not in known:
        known[path] = Encoder(spark, path)
    return known[path]
