"""BM25 of a batch of chunks for a set of questions, within one task, scored only where terms meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from askgrid.functions.ranking import BestChunks, expanded, rounded

K1, B = 1.2, 0.75
#: Pairs of a question's term and a chunk that are scored at a time.
_STEP = 1 << 20
#: More than sums can be off by; a bound is lowered by it before it rules something out.
_SLACK = 1e-6


class Postings:
    """The chunks of a batch by term, each with its saturated frequency and a term's greatest one."""

    def __init__(self, terms: pa.Array, counts: pa.Array, lengths: np.ndarray, vocabulary: int, mean_length: float):
        self.rows = len(lengths)
        row = np.repeat(np.arange(self.rows), np.diff(terms.offsets.to_numpy()))
        term = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        order = np.lexsort((row, term))
        self.row, term, count = row[order], term[order], count[order]
        self.key = term * self.rows + self.row
        self.saturated = count / (count + K1 * (1 - B + B * lengths[self.row] / mean_length))
        self.start = np.searchsorted(term, np.arange(vocabulary))
        self.size = np.bincount(term, minlength=vocabulary)
        self.most = np.zeros(vocabulary)
        met = self.size > 0
        if met.any():
            self.most[met] = np.maximum.reduceat(self.saturated, self.start[met])

    def weights(self, term: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Saturated frequency of each term in the chunk beside it; 0 if it isn't there."""
        if not len(self.key):
            return np.zeros(len(term))
        key = term * self.rows + row
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.saturated[at], 0.0)


class QuestionTerms:
    """The terms of some questions with their weights: question, term and weight, one row each."""

    def __init__(self, question: np.ndarray, term: np.ndarray, weight: np.ndarray, questions: int):
        order = np.lexsort((term, question))
        self.question, self.term, self.weight = question[order], term[order], weight[order]
        self.questions = questions
        self.start = np.searchsorted(self.question, np.arange(questions + 1))

    def of_pairs(self, postings: Postings, question: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Scores of given pairs of a question and a chunk of the batch."""
        pair, step = expanded(self.start[question + 1] - self.start[question])
        at = self.start[question[pair]] + step
        value = self.weight[at] * postings.weights(self.term[at], row[pair])
        return rounded(np.bincount(pair, value, minlength=len(question)))

    def matches(self, postings: Postings, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Question, row and score of all pairs that share a term and score at least the question's `floor`.

        A question's terms that can't lift a chunk to the floor by themselves, all together, find no chunk:
        only the postings of its other terms are gone through, and what those find is looked up for the rest.
        """
        most = self.weight * postings.most[self.term]
        order = np.lexsort((most, self.question))
        term, weight, most = self.term[order], self.weight[order], most[order]
        before = np.concatenate([[0.0], np.cumsum(most)])
        reach = before[1:] - before[self.start[self.question]]  # of this term and all lighter ones
        light = reach < floor[self.question] - _SLACK
        lights = np.bincount(self.question[light], minlength=self.questions)
        rest = before[self.start[:-1] + lights] - before[self.start[:-1]]
        many = np.where(light, 0, postings.size[term])
        ends = np.concatenate([[0], np.cumsum(many)])[self.start]
        turn = ends[:-1] // _STEP
        for number in np.unique(turn[np.diff(ends) > 0]):
            asked = np.flatnonzero(turn == number)
            low = asked[0]
            mine = slice(self.start[low], self.start[asked[-1] + 1])
            at, step = expanded(many[mine])
            at += mine.start
            place = postings.start[term[at]] + step
            key = (self.question[at] - low) * postings.rows + postings.row[place]
            value = weight[at] * postings.saturated[place]
            if len(asked) * postings.rows <= 8 * len(key):
                total = np.bincount(key, value)
                key = np.flatnonzero(total)
                total = total[key]
            else:
                key, of = np.unique(key, return_inverse=True)
                total = np.bincount(of, value)
            question, row = np.divmod(key, postings.rows)
            question += low
            maybe = total + rest[question] >= floor[question] - _SLACK
            question, row, total = question[maybe], row[maybe], total[maybe]
            pair, step = expanded(lights[question])
            at = self.start[question[pair]] + step
            value = weight[at] * postings.weights(term[at], row[pair])
            total = rounded(total + np.bincount(pair, value, minlength=len(question)))
            enough = (total >= floor[question]) & (total > 0)
            yield question[enough], row[enough], total[enough]


class Marks:
    """Given pairs of a question and a chunk id, with scores once they are known."""

    def __init__(self, question: np.ndarray, chunk: np.ndarray, score: np.ndarray, questions: int):
        self.question, self.chunk, self.score = question, chunk.astype(object), score
        self.ahead = np.zeros(len(question), np.int64)
        self.floor = np.full(questions, np.inf)
        np.minimum.at(self.floor, question, score)

    def count(self, question: np.ndarray, score: np.ndarray, code: np.ndarray, own_code: np.ndarray) -> None:
        """Count for each mark the pairs of its question that rank before it: by score, then by the code of
        the chunk's id (`own_code`: the marks' own)."""
        rows = np.concatenate([self.question, question])
        scores = np.concatenate([self.score, score])
        codes = np.concatenate([own_code, code])
        pair = np.arange(len(rows)) >= len(self.question)
        order = np.lexsort((pair, codes, -scores, rows))
        before = np.cumsum(pair[order])
        new = np.concatenate([[True], rows[order][1:] != rows[order][:-1]])
        group = np.cumsum(new) - 1
        base = (before - pair[order])[new][group]
        mark = ~pair[order]
        self.ahead[order[mark]] += (before - base)[mark]


def best_by_text(best: BestChunks, terms: QuestionTerms, postings: Postings, chunks: np.ndarray) -> None:
    for question, row, score in terms.matches(postings, best.floor):
        best.add_pairs(question, score, chunks[row])
