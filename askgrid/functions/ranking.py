"""The best k chunks per question, within one task.

Used inside `mapInArrow`; Spark partitions the chunks, and merges the tasks' results with a window
afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCORE_DIGITS = 9
#: Questions and chunks of a tile, whose scores stay in a core's cache; pairs that are scored in doubles at a time.
_QUESTIONS_AT_A_TIME, _CHUNKS_AT_A_TIME, _PAIRS_AT_A_TIME = 512, 512, 1 << 15


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores to 9 decimals, so that the order of additions cannot decide a tie."""
    scale = 10.0**SCORE_DIGITS
    return np.rint(scores * scale) / scale


def vector_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as rows of doubles scaled to unit length; zero rows stay zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) == 0:
        return values.reshape(0, 0)
    width, rest = divmod(len(values), len(lists))
    if rest or np.any(np.diff(lists.offsets.to_numpy()) != width):
        raise ValueError("vectors must all have the same length")
    matrix = values.reshape(len(lists), width)
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]
    return matrix / np.where(length == 0, 1.0, length)


def identifiers(column: pa.Array) -> np.ndarray:
    return column.to_pandas().to_numpy()


def expanded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 to n - 1 for each of `numbers`, with the place of the number: (places, steps)."""
    places = np.repeat(np.arange(len(numbers)), numbers)
    return places, np.arange(len(places)) - np.repeat(np.cumsum(numbers) - numbers, numbers)


class BestChunks:
    """Running best k of every question in arrays of fixed size, best first, ties by chunk id.

    `floor` holds for each question a score that its k-th best chunk reaches at least, if known ahead;
    chunks below it are left out.
    """

    def __init__(self, questions: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(questions, -np.inf) if floor is None else np.array(floor, np.float64)
        self.scores = np.full((questions, k), -np.inf)
        self.chunks = np.full((questions, k), None, object)

    def add(self, start: int, scores: np.ndarray, chunks: np.ndarray) -> None:
        """Take in scores of some questions (rows, from `start` on) for some chunks (columns)."""
        limit = self.floor[start : start + len(scores)].copy()
        open_ = ~np.isfinite(limit)
        if scores.shape[1] > self.k and open_.any():
            place = scores.shape[1] - self.k
            limit[open_] = np.partition(scores[open_], place, axis=1)[:, place]
        question, chunk = np.nonzero(scores >= limit[:, None])
        self.add_pairs(question + start, scores[question, chunk], chunks[chunk])

    def add_pairs(self, question: np.ndarray, score: np.ndarray, chunk: np.ndarray) -> None:
        """Take in scores of single pairs of a question and a chunk."""
        enough = score >= self.floor[question]
        # At the score of a question's k-th chunk only a lower id counts.
        tied = np.flatnonzero(enough & (score == self.scores[question, self.k - 1]))
        enough[tied] = (chunk[tied].astype(object) < self.chunks[question[tied], self.k - 1]).astype(bool)
        question, score, chunk = question[enough], score[enough], chunk[enough]
        if not len(question):
            return
        asked = np.unique(question)
        held = self.scores[asked] > -np.inf
        question = np.concatenate([np.repeat(asked, held.sum(1)), question])
        score = np.concatenate([self.scores[asked][held], score])
        chunk = np.concatenate([self.chunks[asked][held], chunk.astype(object)])
        order = np.lexsort((-score, question))
        tied = (question[order][1:] == question[order][:-1]) & (score[order][1:] == score[order][:-1])
        if tied.any():
            # Ids are compared for equal scores alone.
            tied = order[np.append(tied, False) | np.append(False, tied)]
            code = np.zeros(len(chunk), np.int64)
            code[tied] = np.unique(chunk[tied], return_inverse=True)[1]
            order = np.lexsort((code, -score, question))
        question, score, chunk = question[order], score[order], chunk[order]
        first = np.flatnonzero(np.concatenate([[True], question[1:] != question[:-1]]))
        place = np.arange(len(question)) - np.repeat(first, np.diff(np.append(first, len(question))))
        best = place < self.k
        self.scores[question[best], place[best]] = score[best]
        self.chunks[question[best], place[best]] = chunk[best]
        self.floor[asked] = np.maximum(self.floor[asked], self.scores[asked, self.k - 1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question, chunk id and score of all that is held."""
        question, place = np.nonzero(self.scores > -np.inf)
        return question, self.chunks[question, place], self.scores[question, place]

    def table(self, questions: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        """Columns question id, chunk id, score, in the types of `schema`."""
        question, chunk, score = self.found()
        data = [questions[question], chunk, score]
        return pa.RecordBatch.from_arrays(
            [pa.array(d, type=f.type, from_pandas=True) for d, f in zip(data, schema)], schema=schema
        )


def _likely(scores: np.ndarray, floor: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (chunk, question) of a tile's scores that may be among a question's best k.

    The scores are off by `slack` at most. A question without a floor takes the tile's k-th best score for it.
    """
    limit = floor - slack
    open_ = np.flatnonzero(~np.isfinite(floor))
    if len(scores) > k and len(open_):
        place = len(scores) - k
        limit[open_] = np.partition(scores[:, open_], place, axis=0)[place] - 2 * slack
    reached = np.flatnonzero(scores.max(axis=0) >= limit)
    chunk, question = np.nonzero(scores[:, reached] >= limit[reached])
    return chunk, reached[question]


def add_similarities(best: BestChunks, questions: np.ndarray, vectors: np.ndarray, chunks: np.ndarray) -> None:
    """Score unit question vectors against a batch of unit chunk vectors, a tile at a time.

    Tiles are scored in single precision. This errs by less than `slack`, so pairs that stay below a question's
    floor by more cannot count; only the others are scored in doubles, which decide.
    """
    if len(chunks) == 0:
        return
    if questions.shape[1] != vectors.shape[1]:
        raise ValueError(f"question vectors have {questions.shape[1]} numbers, chunk vectors {vectors.shape[1]}")
    known = ~np.isnan(vectors).any(axis=1)
    if not known.all():
        vectors, chunks = vectors[known], chunks[known]
    slack = (vectors.shape[1] + 16) * float(np.finfo(np.float32).eps)
    near = vectors.astype(np.float32)
    for start in range(0, len(questions), _QUESTIONS_AT_A_TIME):
        asked = questions[start : start + _QUESTIONS_AT_A_TIME]
        columns = asked.astype(np.float32).T
        waiting, pairs = [], 0
        for first in range(0, len(chunks), _CHUNKS_AT_A_TIME):
            scores = near[first : first + _CHUNKS_AT_A_TIME] @ columns
            floor = best.floor[start : start + len(asked)]
            chunk, question = _likely(scores, floor, best.k, slack)
            waiting.append((chunk + first, question))
            pairs += len(chunk)
            last = first + _CHUNKS_AT_A_TIME >= len(chunks)
            if pairs and (last or pairs >= 8 * len(asked) or not np.isfinite(floor).all()):
                chunk, question = (np.concatenate(column) for column in zip(*waiting, strict=True))
                cuts = range(_PAIRS_AT_A_TIME, pairs, _PAIRS_AT_A_TIME)
                exact = [
                    np.einsum("ij,ij->i", asked[q], vectors[c])
                    for c, q in zip(np.split(chunk, cuts), np.split(question, cuts), strict=True)
                ]
                best.add_pairs(question + start, rounded(np.concatenate(exact)), chunks[chunk])
                waiting, pairs = [], 0
