"""Token counts of a unigram tokenizer by a count-only Viterbi pass.

The vocabulary is that of a public tokenizer file (its path is a parameter; the driver reads the file
and broadcasts its pieces; nothing is trained or copied into the repository). None of the public files
holds a unigram model, so the pieces of piece_bpe_32k.model are given the unigram score
-log(rank + RANK_SHIFT), rank being the piece's id. Texts are cut before each space as the metaspace rule says, a
leading space being supplied. Within a cut an Aho-Corasick automaton enumerates the pieces that
occur; dynamic programming keeps, for each end, the best score, where the last piece starts, and the number of pieces.

Tie rules, as the public tokenizer library has them: of equal scores the one found first stays, starts
ascending; where no piece of one character fits, the unknown piece does, with the least score less
UNKNOWN_PENALTY; neighbouring unknowns fuse and fall back to their UTF-8 bytes, one token each.

Defined results: null or empty texts have 0 tokens; null doc_ids and repeated rows count like any row; an empty
table gives no rows; extra columns are ignored. Very long words take linear time and memory.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
RANK_SHIFT = 10
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Words whose counts a worker remembers at most.
REMEMBERED = 400_000


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a SentencePiece file, by ascending id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), -math.log(i + RANK_SHIFT)) for i in ordinary]


class Counter(dict):
    """word, with its leading space sign -> number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.count(SPACE + word)
        if len(word) <= 64:
            self[word] = found
        return found

    def count(self, word: str) -> int:
        n = len(word)
        # Matches by their start, longer ones later: the order in which the library looks.
        ends: list[list | None] = [None] * n
        for last, (length, score) in self.automaton.iter(word):
            at = last - length + 1
            if ends[at] is None:
                ends[at] = [(last + 1, score)]
            else:
                ends[at].append((last + 1, score))
        best = [0.0] * (n + 1)
        tokens: list[int] = [-1] * (n + 1)
        unknown = [False] * (n + 1)
        tokens[0] = 0
        for at in range(n):
            base, so_far, single = best[at], tokens[at], False
            for end, score in ends[at] or ():
                if end == at + 1:
                    single = True
                s = score + base
                if tokens[end] < 0 or s > best[end]:
                    best[end], tokens[end], unknown[end] = s, so_far + 1, False
            if not single:
                s, end = self.unknown + base, at + 1
                if tokens[end] < 0 or s > best[end]:
                    best[end], tokens[end], unknown[end] = s, so_far + len(word[at].encode("utf-8", "surrogatepass")), True
        return tokens[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")  # the metaspace rule makes them one
        words = text.split(" ")
        return sum(map(self.__getitem__, words if text[0] != " " else words[1:]))


def counted(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens for every row of docs. The vocabulary's size is fixed, so it is broadcast."""
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def run(batches):
        counter = Counter(pieces.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([counter.text(t) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return common.texts(docs).transform(common.in_workers, run, "doc_id long, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return counted(common.table(spark, sf_dir, "documents"))
