"""Alignment of two tokenizers' tokens over whole texts.

Both tokenizers cut the same bytes. The ends of their tokens, added up, are two
rising lists of byte offsets, and a merge of the two with one pointer each finds
where both end: there a group closes, and the tokens that end there are linked.

Tasks give, for each text, its groups and how often each pair of ids is linked;
Spark adds up the pairs of all texts and joins the counts, and the highest count
of each id's pairs, back to the texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BYTE_LEVEL, CONTROLS, RARE, PreTokenized, byte_letters
from .common import heavy_join, materialize, read_table

#: Pairs of ids that are sent to every task at most, at about 40 bytes each; more of them are joined by a shuffle.
MOST_SENT = 1_000_000
#: Characters of text whose results go out together.
OUT_CHARS = 4_000_000

_aligners: dict = {}


def merge(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side stand up to each offset at which both have a token's end.

    The pointer into b moves on to the first end that isn't before a's: for all
    of a's ends at once, that is one search of a sorted list in another. Ends
    rise, or stay where a token has no bytes; such a token belongs to the group
    that ends there.
    """
    j = np.searchsorted(b_ends, a_ends)
    met = j < len(b_ends)
    met[met] = b_ends[j[met]] == a_ends[met]
    if (np.diff(a_ends) > 0).all() and (np.diff(b_ends) > 0).all():
        return np.flatnonzero(met) + 1, j[met] + 1
    common = np.unique(a_ends[met])
    return np.searchsorted(a_ends, common, "right"), np.searchsorted(b_ends, common, "right")


def _ranks(path: str) -> dict[bytes, int] | None:
    """bytes -> id of a byte-level file whose merges stand in the order of the ids that they make; None of other files."""
    spec = json.load(open(path, encoding="utf-8"))
    known, fold, _ = PreTokenized._read(spec)
    if not known or fold:
        return None
    vocab, byte = spec["model"]["vocab"], {c: n for n, c in byte_letters().items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab.get("".join(m), -1) for m in merges]
    special = {t["content"] for t in spec.get("added_tokens") or []}
    single = all(c in vocab for c in byte)
    if not single or any(x >= y for x, y in zip(made, made[1:])) or len(made) + 256 + len(special & set(vocab)) != len(vocab):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}


class Aligner:
    """The tokens of two tokenizer files, and their groups and links. a: of the `tokenizers` library, byte-level; b: of `sentencepiece`."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte = {c: bytes([n]) for n, c in byte_letters().items()}
        a_bytes = [b"".join(byte.get(c, c.encode()) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (a_bytes, b_bytes))
        # the digits of every number that is an id, and how many there are; one more place for what follows
        most = max(len(a_bytes), len(b_bytes))
        self.digits = np.zeros((most, len(str(most)) + 1), np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(most)])
        for i in range(most):
            self.digits[i, : self.n_digits[i]] = list(str(i).encode())
        self.fast = None
        if ranks := _ranks(a):
            import tiktoken

            # the same merges by another library, which runs them several times as fast
            self.fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def a_ids(self, text: str) -> np.ndarray:
        # libraries may know letters of late Unicode versions, and a few controls, from one another differently
        if self.fast is None or any(c in text for c in CONTROLS) or not text.isascii() and RARE.search(text):
            return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def shown(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> str:
        """Groups as a1,a2|b1;a3|b2,b3. They end before token i of a and token j of b."""
        i0, j0 = np.append(0, i[:-1]), np.append(0, j[:-1])
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(j0, i - i0)] = a
        ids[np.arange(len(b)) + np.repeat(i, j - j0)] = b
        after[i + j0 - 1], after[i + j - 1] = ord("|"), ord(";")
        rows, n = self.digits[ids], self.n_digits[ids]
        rows[np.arange(len(ids)), n] = after
        return rows[np.arange(rows.shape[1]) <= n[:, None]][:-1].tobytes().decode()

    def text(self, text: str) -> tuple:
        """(groups as text, number of ids of a, of b, of groups, codes of the links, how often each) of a text; nothing where the bytes aren't those of a space and the text."""
        given = " " + text
        b_ids = self.b.encode(text)
        raw, a, b = given.encode(), self.a_ids(given), np.array(b_ids, np.int64)
        a_size, b_size = self.a_size[a], self.b_size[b]
        a_ends, b_ends = a_size.cumsum(), b_size.cumsum()
        # what the fast library gives is the text's own bytes, cut
        same = int(b_ends[-1]) == len(raw) == int(a_ends[-1]) if len(a) and len(b) else False
        same = same and b"".join(map(self.b_bytes.__getitem__, b_ids)) == raw
        if not same or self.fast is None and b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
            return "", 0, 0, 0, (), ()
        i, j = merge(a_ends, b_ends)
        if a_size.all() and b_size.all():  # one token of each side ends there
            codes = a[i - 1] << 32 | b[j - 1]
        else:
            first = lambda ends: np.searchsorted(ends, a_ends[i - 1])
            codes = np.concatenate([(a[k:x][:, None] << 32 | b[m:y]).ravel() for k, x, m, y in zip(first(a_ends), i, first(b_ends), j)])
        codes, times = np.unique(codes, return_counts=True)
        return self.shown(a, b, i, j), len(a), len(b), len(i), codes, times


def alignments(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times of every row.

    a is a byte-level file of the `tokenizers` library, given a space and the
    text; b a `sentencepiece` model that adds the space itself. groups is
    `a1,a2|b1;a3|b2,b3`; pairs are the linked ids as id of a * 2^32 + id of b,
    and times says how often each is linked in the text. A text that is null or
    empty, or whose tokens' bytes aren't those of the space and the text, has no
    tokens: zeros, an empty string and empty arrays. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a, b)
        if key not in _aligners:
            _aligners.clear()
            _aligners[key] = Aligner(a, b)
        aligner = _aligners[key]
        for batch in batches:
            start, at, size, n, out = 0, 0, 0, batch.num_rows, []
            texts = batch.column("_text")
            while at < n:
                text = texts[at].as_py()
                out.append(aligner.text(text) if text else ("", 0, 0, 0, (), ()))
                at, size = at + 1, size + len(text)
                if size >= OUT_CHARS or at == n:
                    yield made(batch.column("doc_id").slice(start, at - start), out)
                    start, size, out = at, 0, []

    def made(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        shown, n_a, n_b, n_groups, codes, times = zip(*out)
        ends = pa.array(np.cumsum([0, *map(len, codes)]), pa.int32())
        joined = lambda parts: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.asarray(p, np.int64) for p in parts]), pa.int64()))
        links = [int(np.sum(x)) for x in times]
        columns = [ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, links)), pa.array(shown, pa.string()), joined(codes), joined(times)]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, n (links of all texts), n_docs (rows that hold it), best_a and best_b (highest n among the pairs of its a, and of its b)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    n = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    n = n.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(2**32 - 1))})
    most = lambda c: F.max("n").over(Window.partitionBy(c))  # an id's pairs are at most as many as the other side has ids
    return n.withColumns({"best_a": most("a"), "best_b": most("b")})


def with_pair_counts(aligned: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """aligned (a stored table with pairs and times), with n_best_a, n_best (links whose pair is the most frequent of its a, of its b; ties included) and count_sum (their pairs' counts added up), without pairs and times.

    The pairs' counts go to every task if there are at most `most_sent`; beyond
    that, the rows of a pair meet them in a shuffle, and only the few pairs that
    very many texts hold are sent.
    """
    aligned = materialize(aligned.withColumn("_row", F.monotonically_increasing_id()), "alignment")
    counts = materialize(pair_counts(aligned), "alignment-pairs")
    each = aligned.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    right = counts.select("pair", "n", "n_docs", (F.col("n") == F.col("best_a")).alias("top_a"), (F.col("n") == F.col("best_b")).alias("top_b"))
    n_pairs, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    both = each.join(F.broadcast(right), "pair") if n_pairs <= most_sent else heavy_join(each, right, "pair", "n_docs", total)
    sums = both.groupBy("_row").agg(F.sum(F.when(F.col("top_a"), F.col("times")).otherwise(0)).alias("n_best_a"), F.sum(F.when(F.col("top_b"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = aligned.drop("pairs", "times").join(sums, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best_a", "n_best", "count_sum")})


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as T

    found = alignments(read_table(spark, sf_dir, "documents"), T.path("byte_bpe_50k.json"), T.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    out = with_pair_counts(found.withColumn("groups_sha256", digest).drop("groups"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")
