"""Operator 11: token counts of whole texts; huge ones are cut into overlapping chunks and spliced."""

from __future__ import annotations

import json
import math
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_runs, stored, whole_text
from .tokens import default_vocabulary, encoder

#: How far the word pattern looks ahead, in characters.
LOOK_AHEAD = 3
_SEAM = "row long, start long, right long, width long, last boolean, text string"


class Counter:
    """One library's tokenizer: counts texts, and lists the places where it always ends a word.

    ``cuttable``: the tokenizer splits a text into words from left to right, looking at
    what follows only (byte-level pattern, no normaliser), and tokens never cross words.
    Then the words of a text from a word's end on are those of the rest alone. Others
    (sentencepiece models, normalising tokenizers) encode every text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.pieces, self.cuttable = SentencePieceProcessor(model_file=path), False
            return
        from tokenizers import Tokenizer

        self.pieces, self.tokenizer = None, Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        form = json.loads(self.tokenizer.to_str())
        split = form.get("pre_tokenizer") or {}
        self.cuttable = (form.get("normalizer") is None and split.get("type") == "ByteLevel"
                         and split.get("use_regex", False) and not split.get("add_prefix_space", True)
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in form.get("added_tokens", ())))
        self.words = encoder(path) if self.cuttable else None
        longest = max((len(t["content"]) for t in form.get("added_tokens", ())), default=0)
        #: A word's end this far before a cut is the same whatever follows the cut.
        self.margin = longest + LOOK_AHEAD

    def count(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        if self.words is not None:  # equal words of many texts are encoded once
            return np.diff(self.words.encode(pa.array(texts, pa.string()))[1]).tolist()
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places where words start or the text ends, and the number of tokens before each."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        word = np.asarray(e.word_ids, dtype=np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        at = np.fromiter((a for a, _ in e.offsets), dtype=np.int64, count=len(word))[first]
        return np.append(at, len(text)), np.append(first, len(word))

    def splice(self, text: str, cut: int, whole: bool) -> int | None:
        """Tokens of ``text`` less those of ``text[cut:]``, were both read on to the document's end.

        Both encodings are looked through for a common word end that what follows the
        text cannot move; from there on they are equal. None if there is none.
        """
        sure = len(text) if whole else len(text) - self.margin
        left, before = self.ends(text)
        right, skipped = self.ends(text[cut:])
        right = right + cut
        common, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
        if not len(common) or common[0] > sure:
            return None
        return int(before[i[0]] - skipped[j[0]])


def counter(path: str) -> Counter:
    """This Python worker's tokenizer; it outlives the task."""
    own = vars(sys).setdefault("_epiframe_counters", {})
    if path not in own:
        own[path] = Counter(path)
    return own[path]


def _seams(text: str, chunk: int, width: int) -> Iterator[tuple[int, int, int]]:
    for start in range(0, len(text), chunk):
        yield start, start + chunk, width


def _widened(seams: list[dict], chunk: int) -> Iterator[tuple[int, int, int]]:
    """Failed seams with twice the overlap; from a whole chunk on, neighbours become one seam."""
    run: list[int] | None = None
    for s in sorted(seams, key=lambda s: s["start"]):
        width = 2 * s["width"]
        if run and run[1] == s["start"] and run[2] >= chunk:
            run = [run[0], s["right"], max(run[2], width)]
            continue
        if run:
            yield tuple(run)
        run = [s["start"], s["right"], width]
    if run:
        yield tuple(run)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 limit: int = 1024, chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """Tokens of every whole text, as the vocabulary's library counts them.

    Returns doc_id (``id_col``), n_bytes, n_tokens, over_limit (n_tokens > ``limit``),
    n_chunks (chunks the text was counted in); one row per input row.

    A text of more than ``chunk_chars`` characters is cut into chunks dealt over all
    tasks. Let E(i) be the encoding of the text from chunk i's start to its end. If E(i)
    and E(i+1) have a word's end p in common, they are equal from p on, so tokens(E(i)) =
    tokens of E(i) before p - tokens of E(i+1) before p + tokens(E(i+1)). Each seam looks
    for such a p in ``overlap`` characters of both sides (far enough from the overlap's
    end that the text behind it cannot move p), and the document's count is the sum over
    its seams plus the last chunk. A seam without one is tried again with twice the
    overlap; from a whole chunk on, neighbouring failures are one seam, since they lie in
    one long word, which has to be encoded whole. It ends at the latest at the
    document's end, which all encodings share.

    Null texts count as empty: 0 tokens. Null and repeated ids and repeated rows are rows
    of their own. An empty table gives an empty one. Other columns of ``docs`` are not
    read, whatever their names. Special tokens' strings in a text are what the library
    makes of them by default.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(F.col(f"`{text_col}`")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = counter(vocabulary), TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, hi in row_runs(b.column("text")):
                texts = b.column("text").slice(lo, hi - lo).to_pylist()
                long = [tokens.cuttable and len(t) > chunk_chars for t in texts]
                n = iter(tokens.count([t for t, cut in zip(texts, long) if not cut]))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(range(row, row + len(texts)), pa.int64()), "doc_id": b.column("doc_id").slice(lo, hi - lo),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array([None if cut else next(n) for cut in long], pa.int64()),
                    "text": pa.array([t if cut else None for t, cut in zip(texts, long)], pa.string())})
                row += len(texts)

    counted = stored(rows.mapInArrow(count, f"row long, doc_id {id_type}, n_bytes long, n_tokens long, text string"), "counted")
    huge = counted.filter(F.col("n_tokens").isNull()).select("row", "text", "n_bytes")
    tasks = math.ceil((huge.agg(F.sum("n_bytes")).first()[0] or 0) / (1 << 20))
    if not tasks:
        return _result(counted, limit, F.lit(1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                text = r["text"]
                seams = _widened(r["seams"], chunk_chars) if r.get("seams") else _seams(text, chunk_chars, overlap)
                for start, right, width in seams:
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array([r["row"]], pa.int64()), "start": pa.array([start], pa.int64()), "right": pa.array([right], pa.int64()),
                        "width": pa.array([width], pa.int64()), "last": pa.array([right + width >= len(text)]), "text": [text[start:right + width]]})

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for b in batches:
            n = []
            for r in b.to_pylist():
                at = r["right"] - r["start"]
                n.append(tokens.count([r["text"]])[0] if at >= len(r["text"]) else tokens.splice(r["text"], at, r["last"]))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("row", "start", "right", "width")} | {"n": pa.array(n, pa.int64())})

    todo, found = huge.select("row", "text"), None
    while True:
        seams = todo.mapInArrow(cut, _SEAM).repartition(tasks, "row", "start")
        tried = stored(seams.mapInArrow(splice, "row long, start long, right long, width long, n long"), "seams")
        good = tried.filter(F.col("n").isNotNull()).select("row", "n")
        found = good if found is None else found.unionByName(good)
        failed = tried.filter(F.col("n").isNull()).groupBy("row").agg(F.collect_list(F.struct("start", "right", "width")).alias("seams"))
        if failed.isEmpty():
            break
        todo = huge.select("row", "text").join(failed, "row")
    spliced = found.groupBy("row").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_chunks"))
    whole = counted.select("row", "doc_id", "n_bytes", "n_tokens").join(spliced, "row", "left")
    return _result(whole.withColumn("n_tokens", F.coalesce("n_tokens", "_n")), limit, F.coalesce("_chunks", F.lit(1)))


def _result(counted: DataFrame, limit: int, chunks) -> DataFrame:
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                          chunks.cast("int").alias("n_chunks"))
