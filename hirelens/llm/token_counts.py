"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens.

A pre-token is a word with its leading blank mark. The distinct pre-tokens of a slice of
documents are put in a trie; the best score of every prefix, and the pieces it takes, is
computed once at the trie node that all words with this prefix share. The count at a word's
terminal node is its token count.

Scores: a vocabulary file of pieces has ranks, from which the score of a piece is
-log(rank + 2). The best segmentation has the highest sum of scores; of equal sums the one
with fewer pieces counts. A character in no piece costs UNKNOWN and takes a piece per UTF-8 byte.

Cases: null and empty texts have 0 tokens; blanks only give 0; an empty table gives no rows;
repeated rows are counted again; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.llm.chunks import vocabulary
from hirelens.llm.common import WORD

MARK, UNKNOWN = "▁", -30.0
#: Pre-tokens whose counts a worker keeps between slices of documents.
KEPT = 500_000
_loaded: dict[str, tuple[dict[str, float], int]] = {}
_counts: dict[str, dict[str, int]] = {}


def piece_scores(path: str) -> tuple[dict[str, float], int]:
    """Score by piece, and the longest piece's characters. Control and byte pieces are left out."""
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {model.id_to_piece(i): -math.log(i + 2) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        _loaded[path] = scores, max(map(len, scores))
    return _loaded[path]


def trie_counts(words: list[str], scores: dict[str, float], longest: int) -> dict[str, int]:
    """Tokens of each word. Sorted words are the trie in depth-first order: `path` holds the
    nodes (best score, pieces) from the root to the current one, and a word goes on from the
    deepest node that it shares with the word before."""
    out: dict[str, int] = {}
    path: list[tuple[float, int]] = [(0.0, 0)]
    last = ""
    get = scores.get
    for word in sorted(words):
        shared, most = 0, min(len(last), len(word))
        while shared < most and last[shared] == word[shared]:
            shared += 1
        del path[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            score, count = path[end - 1]
            best, pieces = score + UNKNOWN, count + len(word[end - 1].encode("utf-8", "surrogatepass"))
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    score, count = path[start]
                    if score + s > best or (score + s == best and count + 1 < pieces):
                        best, pieces = score + s, count + 1
            path.append((best, pieces))
        out[word] = path[-1][1]
        last = word
    return out


def token_counts(docs: DataFrame, path: str | None = None, slice_rows: int = 2000, slice_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    path = path or vocabulary("piece_bpe_32k.model")
    find = re.compile(WORD).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = piece_scores(path)
        kept = _counts.setdefault(path, {})

        def counted(names: list, texts: list[str]) -> pa.RecordBatch:
            words = [find(t) for t in texts]
            missing = set().union(*words) - kept.keys()
            if len(kept) + len(missing) > KEPT:
                kept.clear()
                missing = set().union(*words)
            new = trie_counts([MARK + w for w in missing], scores, longest)
            kept.update((w[1:], n) for w, n in new.items())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(kept.__getitem__, w)) for w in words], pa.int64())], ["doc_id", "n_words", "n_tokens"])

        for batch in batches:
            names: list = []
            texts: list[str] = []
            size = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                names.append(doc)
                texts.append(text or "")
                size += len(text or "")
                if len(texts) >= slice_rows or size >= slice_chars:
                    yield counted(names, texts)
                    names, texts, size = [], [], 0
            if texts:
                yield counted(names, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")


def corpus_token_counts(counts: DataFrame, docs: DataFrame, by: str = "source") -> DataFrame:
    """Tokens, words and documents per group of the corpus."""
    groups = docs.select("doc_id", by).distinct()
    return counts.join(groups, "doc_id").groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
