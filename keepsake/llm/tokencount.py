"""Count-only Viterbi: token counts of a unigram model without building tokens."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MARK = "▁"
#: Fixed value: what an unknown character costs below the worst piece.
UNKNOWN_PENALTY = 10.0


def vocabulary(name: str = "piece_bpe_32k.model", folder: str | None = None) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores of a public sentencepiece file, and the unknown piece's id; the unigram
    model takes the scores as they are."""
    import public_tokenizers
    import sentencepiece

    path = os.path.join(folder, name) if folder else public_tokenizers.path(name)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    """Tokens of a text under a unigram vocabulary, by the rules of the tokenizers library:

    spaces become MARK, one goes before the text if it has none, and words begin at MARK. Within a
    word, at each character, pieces that begin there extend the best path; a path replaces
    another only if its score is greater, so of equal ones the first found, that with the
    earlier last cut, stays; an unknown character is a path only where no piece is that very
    character. Unknown characters count as their bytes, if the vocabulary has bytes; otherwise
    each run of them is one token."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matcher = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for p, s in pieces:
            scores[p] = s  # a repeated piece has its last score
        for p, s in scores.items():
            if p:
                self.matcher.add_word(p, (len(p), s))
        self.matcher.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.by_bytes = all(f"<0x{i:02X}>" in scores for i in range(256))
        self.words = tokens.Chunks(lambda ws: [self.word(w) for w in ws], 400_000)

    def word(self, word: str) -> int:
        """The automaton names matches by their last character, longest first, so the pieces that
        end at one place come in the order of their starts; all of those starts are settled."""
        n = len(word)
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.matcher.iter(word):
            ends[end].append(match)
        for at in range(n):
            best, here, alone = None, 0, False
            for length, s in sorted(ends[at], reverse=True):
                begin = at + 1 - length
                alone = alone or length == 1
                new = s + score[begin]
                if best is None or new > best:
                    best, here = new, count[begin] + 1
            unknown = False
            if not alone:
                new = self.unknown + score[at]
                if best is None or new > best:
                    unknown, best = True, new
                    here = count[at] + (len(word[at].encode()) if self.by_bytes else int(not run[at]))
            score[at + 1], count[at + 1], run[at + 1] = best, here, unknown
        return count[n]

    def batch(self, texts: list[str]) -> list[int]:
        split, need = [], set()
        for t in texts:
            t = t.replace(" ", MARK)
            parts = t.split(MARK)[t.startswith(MARK) :] if t else []
            split.append(parts)
            need.update(parts)
        known = self.words.ensure({MARK + w for w in need})
        return [sum(known[MARK + w] for w in parts) for parts in split]


@lru_cache(maxsize=2)
def counter(name: str, folder: str | None = None) -> Counter:
    return Counter(vocabulary(name, folder)[0])


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and n_tokens long, over the whole text (null or empty: 0). No shuffle.
    Words are scored once a worker while a bounded table remembers them. Repeated rows and null
    ids give a row each; other columns are not read; an empty table gives none."""
    kind = dict(docs.dtypes)[id_col]

    def count(batches):
        import pyarrow as pa

        own = counter(model, folder)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c for i in range(0, len(texts), 256) for c in own.batch(texts[i : i + 256])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(F.col(id_col), common.text_of(text_col).alias("_text")).mapInArrow(count, f"{id_col} {kind}, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
