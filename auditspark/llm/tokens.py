"""Operator 2: token counts behind a digest cache, and the batch encoder that
the packing operator shares.

``count_tokens`` joins the content digest of every text with stored counts of
the same tokenizer version, encodes each distinct missing text once and appends
the new counts to the cache.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import shared_dir, ship, table, written

VOCABULARY = "byte_bpe_50k.json"
OVER = 1024

#: Characters that some regular-expression engine takes as white space, besides
#: space and line feed.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A space with white space on both sides (or at the end of the text).  There a
#: cut before each space would not fall between two pre-tokens.
_UNSAFE = re.compile(r"\s (?=\s|\Z)")
_LONG = 512
_SLICE = 2 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: counts of another version never match."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class ChunkEncoder:
    """Encodes batches of texts with the library's tokenizer, remembering chunks.

    A chunk is a word with the space before it.  The byte-level pre-tokenizer
    never joins characters across such a cut (texts where it could are given to
    the library whole), so a text's ids are its chunks' ids in a row.  Chunks of
    a batch are dictionary-encoded by Arrow, and only chunks not seen before are
    encoded: by the rank form of the same vocabulary where there is one, which
    gives the same ids several times faster, else by the library.
    """

    def __init__(self, path: str, ranks_path: str | None = None, remember: int = 150_000):
        self.path = path
        with open(path, encoding="utf-8") as f:
            head = f.read()
        at = head.find("[", head.find('"added_tokens"'))
        self.special = [x["content"] for x in json.JSONDecoder().raw_decode(head, at)[0]]
        self.remember = remember
        self.known: dict[str, int] = {}  # by word: the chunk of a space and the word
        self.opening: dict[str, int] = {}  # first words, with no space before them
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.n_chunks = 0
        self.ranks = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, i in ranks.items():
                self.width[i] = len(token)

    @cached_property
    def tokenizer(self):
        """The library's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def opening_ids(self, word: str) -> np.ndarray:
        if self.ranks and len(word) <= _LONG:
            return np.array(self.ranks.encode_ordinary(word), dtype=np.uint32)
        return self.whole(word)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _store(self, known: dict[str, int], words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Remember words whose ids lie in a row and end at ``ends``."""
        at = int(self.starts[self.n_chunks])
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_chunks + len(words) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[at : at + len(ids)] = ids
        self.starts[self.n_chunks + 1 : self.n_chunks + 1 + len(words)] = at + ends
        known.update(zip(words, range(self.n_chunks, self.n_chunks + len(words)), strict=True))
        self.n_chunks += len(words)

    def _learn(self, words: list[str]) -> None:
        """Encode chunks (a space and a word) that are new."""
        # In one string, ordinary chunks split as they do alone; those with more white space in front do not.
        short = [w for w in words if w and len(w) <= _LONG and not w[0].isspace()] if self.ranks else []
        if short:
            ids = np.asarray(self.ranks.encode_to_numpy(" " + " ".join(short), disallowed_special=()), dtype=np.uint32)
            ends = np.cumsum(pc.binary_length(pa.array(short).cast(pa.binary())).to_numpy().astype(np.int64) + 1)
            at = np.cumsum(self.width[ids])
            cuts = np.searchsorted(at, ends)
            if np.array_equal(at[np.minimum(cuts, len(at) - 1)], ends):
                self._store(self.known, short, ids, cuts + 1)
        for w in words if len(short) < len(words) or short[0] not in self.known else ():
            if w not in self.known:
                ids = self.whole(" " + w)
                self._store(self.known, [w], ids, np.array([len(ids)]))

    def _plain(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        return not (("  " in text or "\n " in text or _RARE_SPACE.search(text)) and _UNSAFE.search(text))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more entry at the end)."""
        if self.n_chunks > self.remember:
            self.known, self.opening, self.n_chunks = {}, {}, 0
        plain = [t if t and self._plain(t) else "" for t in texts]
        parts = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        words = parts.values.dictionary_encode() if len(parts.values) else None
        first = parts.offsets.to_numpy()[:-1]
        bounds = parts.offsets.to_numpy()
        if words is None:
            code = np.zeros(0, dtype=np.int64)
        else:
            names = words.dictionary.to_pylist()
            found = list(map(self.known.get, names))
            if None in found:
                self._learn([w for w, k in zip(names, found, strict=True) if k is None])
                found = list(map(self.known.get, names))
            code = np.array(found, dtype=np.int64)[words.indices.to_numpy()]
        alone = {}
        for i, t in enumerate(texts):
            if t and not plain[i]:
                alone[i] = self.whole(t)
            elif t:  # its first word has no space before it
                word = t.partition(" ")[0]
                if word not in self.opening:
                    ids = self.opening_ids(word)
                    self._store(self.opening, [word], ids, np.array([len(ids)]))
                k = self.opening[word]
                alone[i] = self.ids[self.starts[k] : self.starts[k + 1]]
        # length in ids of each chunk; the first chunk of a text is replaced by its own encoding
        size = self.starts[code + 1] - self.starts[code] if len(code) else np.zeros(0, dtype=np.int64)
        begin = self.starts[code].copy() if len(code) else np.zeros(0, dtype=np.int64)
        extra, at = [], int(self.starts[self.n_chunks])
        for i, j in enumerate(first.tolist()):
            ids = alone.get(i)
            extra.append(ids if ids is not None else np.zeros(0, dtype=np.uint32))
            size[j], begin[j] = len(extra[-1]), at
            at += len(extra[-1])
        pool = np.concatenate([self.ids[: self.starts[self.n_chunks]], *extra]) if extra else self.ids[:0]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return pool[index], total[bounds]

    def slices(self, texts: pa.Array):
        """(first row, texts, ids, offsets) for slices of a column that hold a few MB each."""
        weight = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = weight[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(weight, done + _SLICE, side="right")))
            part = texts.slice(at, end - at).to_pylist()
            yield (at, part, *self.encode(part))
            at = end


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, ranks_path: str | None = None) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary."""
    key = (path, ranks_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, ranks_path)
    return _ENCODERS[key]


def ranks_of(name: str) -> str | None:
    """The rank form of a vocabulary, if the tokenizer folder has one."""
    import os

    path = vocabulary_path(name)
    ranks = path.removesuffix(".json") + ".tiktoken"
    return ranks if path.endswith(".json") and os.path.exists(ranks) else None


_CACHE = "tokenizer string, digest binary, n_tokens long"
#: Up to so many misses go to every task; more are met by shuffling the texts once.
FEW_MISSES = 10_000
#: Name of the cache's folder in the shared folder.
CACHE = "token-counts-cache"


def empty_cache(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], _CACHE)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table before the first run."""
    try:
        return spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_cache(spark)


def count_tokens(docs: DataFrame, cache: DataFrame | None = None, vocabulary: str = VOCABULARY, over: int = OVER) -> tuple[DataFrame, DataFrame]:
    """Token counts of every whole text, and the rows to append to the cache.

    ``cache`` has ``tokenizer`` (digest of the tokenizer's file), ``digest``
    (SHA-256 of the text as binary) and ``n_tokens``; rows that repeat a digest
    count once.  Normalisation for the digest is only null -> empty: every other
    change could change the ids.  Only texts whose digest is not stored are
    encoded, and of equal texts one: of the smallest doc_id (rows that repeat
    this id and the text may each be encoded).

    Nulls and empty texts count 0 tokens; texts of any length are encoded whole;
    repeated rows (also of one doc_id) each get a row; an empty table gives an
    empty result.  Other columns of ``docs`` are neither used nor returned, so
    their names cannot clash.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    path, ranks = vocabulary_path(vocabulary), ranks_of(vocabulary)
    version = tokenizer_version(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    # Digests are computed while reading; only 40 bytes of a row are shuffled.
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    stored = (empty_cache(spark) if cache is None else cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # One row stands for each distinct missing text: copies meet before the shuffle.
    missing = written(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored, "digest", "left_anti"), "token-misses").alias("m")
    texts = docs.select("doc_id", text.alias("text"), digest.alias("digest")).alias("d")

    def encode(batches):
        enc = encoder(path, ranks)
        for b in batches:
            n, d = [], []
            for _, part, _, offsets in enc.slices(b.column("text")):
                n.append(np.diff(offsets))
                d += [hashlib.sha256(t.encode()).digest() for t in part]
            counts = np.concatenate(n) if n else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(d), pa.string()), pa.array(d, pa.binary()), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    n = missing.count()
    chosen = texts.join(F.broadcast(missing) if n <= FEW_MISSES else missing, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.digest") == F.col("m.digest")), "left_semi").select("text")
    new = written(chosen.mapInArrow(encode, _CACHE).dropDuplicates(["digest"]), "token-new")
    known = new.select("digest", "n_tokens")
    if cache is not None:
        known = written(stored.unionByName(known), "token-counts")
    out = keyed.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
    return out, new


def count_with_cache(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, over: int = OVER) -> DataFrame:
    """``count_tokens`` behind the cache at ``path``, which gets the new counts.

    Appending is one commit of a Spark write.  Two runs at once may both append a
    digest; that changes no count.  A cache is never rewritten: counts of another
    version of the tokenizer stay beside the new ones.
    """
    spark = docs.sparkSession
    out, new = count_tokens(docs, read_cache(spark, path), vocabulary, over)
    if not new.isEmpty():
        new.write.mode("append").parquet(path)
    return out


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, behind the cache
    in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    return count_with_cache(docs, f"{shared_dir(spark)}/{CACHE}").select("doc_id", "n_bytes", "n_tokens", "over_limit")
