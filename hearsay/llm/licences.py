"""Licence texts and notices in documents: Dice coefficient over word bigrams with templates.

A document is normalised to words; any span of words may match, whatever its lines. Dice of at least
t with a template of m bigrams needs t m / (2 - t) of them in the span and at most (2 - t) m / t
different bigrams there. Templates with fewer hits in a document are left; of the others the best
end of each span is found once, and spans are taken from the best on, so that no two overlap.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8
from .licence_texts import TEMPLATES

THRESHOLD = 0.8
CELLS = 1 << 20  # of windows looked at together
WORD = re.compile(rb"[a-z0-9]+")
COPYRIGHT = re.compile(rb"^\W*(?:copyright|\(c\)|\xc2\xa9)[^\n]*\d{4}[^\n]*$", re.MULTILINE)

SPDX = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
SPDX_WORD = re.compile(rb"[a-z0-9.+-]+")


def _each_licence(expression: re.Match) -> bytes:
    """An identifier line for each licence of an SPDX expression; exceptions are no licences."""
    named, after = [], b""
    for word in SPDX_WORD.findall(expression[1]):
        if word not in (b"or", b"and", b"with") and after != b"with":
            named.append(b"spdx-license-identifier: " + word)
        after = word
    # An expression ends with its line, but prose may follow an identifier there.
    several = re.search(rb"(?<![a-z0-9.+-])(?:or|and|with)(?![a-z0-9.+-])", expression[1])
    return b" ".join(named) if several and len(named) > 1 else expression[0]


def lines_of(text: bytes) -> list[list[bytes]]:
    """The words of each line: ASCII letters and digits, lower-cased, "licence" read as "license";
    copyright lines are empty, and SPDX expressions are spelt out licence by licence."""
    lowered = COPYRIGHT.sub(b"", text.lower()).replace(b"licence", b"license")
    lowered = SPDX.sub(_each_licence, lowered)
    return [WORD.findall(line) for line in lowered.split(b"\n")]


def bigrams(words: list[bytes]) -> frozenset:
    return frozenset(zip(words, words[1:]))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by name, and for each bigram the templates that hold it."""

    def __init__(self, texts: list[tuple[str, str]], threshold: float) -> None:
        self.threshold = threshold
        self.names = [name for name, _ in texts]
        self.grams = [
            bigrams([w for line in lines_of(text.encode()) for w in line]) for _, text in texts
        ]
        self.index: dict[tuple, list[int]] = {}
        for i, grams in enumerate(self.grams):
            for g in grams:
                self.index.setdefault(g, []).append(i)
        # "this work is licensed under the" is most of many a notice, but tells no licence.
        most = max(1, len(set(self.names)) // 2)
        self.telling = {
            g for g, held in self.index.items() if len({self.names[i] for i in held}) <= most
        }

    def find_spans(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """``(licence, dice, first line, last line)`` of spans that do not overlap, best first.

        The best span of all is taken, then the best that does not overlap it, and so on, whatever
        their licences; equal ones by name, then by place.
        """
        words, line_of = [], []
        for at, line in enumerate(lines_of(text)):
            words += line
            line_of += [at] * len(line)
        pairs = list(zip(words, words[1:]))
        hits: dict[int, int] = {}
        for g in set(pairs) & self.index.keys():
            for i in self.index[g]:
                hits[i] = hits.get(i, 0) + 1
        t = self.threshold
        near = [i for i, n in hits.items() if n * (2 - t) >= t * len(self.grams[i]) - 1e-9]
        if not near:
            return []
        last: dict[tuple, int] = {}
        before = np.empty(len(pairs), dtype=np.int64)
        for p, g in enumerate(pairs):
            before[p] = last.get(g, -1)
            last[g] = p
        telling = np.fromiter((g in self.telling for g in pairs), dtype=bool, count=len(pairs))
        views = {}
        for i in near:
            own = self.grams[i]
            inside = np.fromiter((g in own for g in pairs), dtype=bool, count=len(pairs))
            views[i] = _View(len(own), hits[i], t, inside, inside & telling, before)
        return sorted(
            (
                (self.names[i], value, line_of[a], line_of[b + 1])
                for value, a, b, i in self._chosen(views, len(pairs))
            ),
            key=lambda m: (-m[1], m[0], m[2]),
        )

    def _chosen(self, views: dict[int, _View], n: int) -> list[tuple[float, int, int, int]]:
        """``(dice, first bigram, last bigram, template)`` of the spans that are taken.

        A best span cannot be made better by one more bigram of the template before it, so spans
        are looked for where a run of such bigrams begins: after another bigram, or after a span
        that is taken. One that crosses a taken span is cut there and waits again.
        """
        heap: list[tuple[float, str, int, int, int]] = []

        def wait(i: int, starts: np.ndarray, stops: np.ndarray) -> None:
            values, ends = views[i].best_ends(starts, stops)
            for k in np.flatnonzero(values >= self.threshold - 1e-12):
                heapq.heappush(
                    heap, (-float(values[k]), self.names[i], int(starts[k]), int(ends[k]), i)
                )

        for i, view in views.items():
            after = np.concatenate(([False], view.inside[:-1]))
            starts = np.flatnonzero(view.inside & ~after)
            wait(i, starts, np.full(len(starts), n))
        taken: list[tuple[int, int]] = []  # in the order of their places
        chosen = []
        while heap:
            value, _, a, b, i = heapq.heappop(heap)
            at = bisect.bisect_right(taken, (a, n))
            if at and taken[at - 1][1] >= a:
                continue  # its start is taken; where that span ends, starts were added
            if at < len(taken) and taken[at][0] <= b:
                wait(i, np.array([a]), np.array([taken[at][0]]))
                continue
            taken.insert(at, (a, b))
            chosen.append((-value, a, b, i))
            stop = taken[at + 1][0] if at + 1 < len(taken) else n
            for j, view in views.items():
                # A run that goes on behind the span; others begin by themselves.
                if b + 1 < stop and view.inside[b] and view.inside[b + 1]:
                    wait(j, np.array([b + 1]), np.array([stop]))
        return chosen


class _View:
    """A document's bigrams as one template sees them."""

    def __init__(self, own: int, held: int, t: float, inside, telling, before) -> None:
        self.own, self.held, self.t = own, held, t
        self.inside, self.telling, self.before = inside, telling, before

    def best_ends(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best Dice of the spans from each start that end before its stop, and the last bigram of
        that span. A span holds at least one telling bigram of the template."""
        values, ends = np.zeros(len(starts)), starts.copy()
        # Beyond so many different bigrams Dice stays below the threshold.
        most = (2 - self.t) * self.own / self.t
        todo, width = np.arange(len(starts)), 2 * self.own + 8
        while len(todo):
            rest = []
            for k in range(0, len(todo), max(1, CELLS // width)):
                rows = todo[k : k + max(1, CELLS // width)]
                a, stop = starts[rows, None], stops[rows, None]
                at = a + np.arange(width)
                there = at < stop
                at = np.minimum(at, len(self.inside) - 1)
                new = (self.before[at] < a) & there
                size = np.cumsum(new, axis=1, dtype=np.int32)
                common = np.cumsum(new & self.inside[at], axis=1, dtype=np.int32)
                tells = np.logical_or.accumulate(self.telling[at] & there, axis=1)
                dice = np.where(tells & there, 2 * common / (size + self.own), 0.0)
                best = dice.argmax(axis=1)
                values[rows], ends[rows] = dice[np.arange(len(rows)), best], starts[rows] + best
                # Repeated bigrams take room; such windows are looked at again, twice as wide,
                # unless they have all of the template's bigrams that the document holds.
                wider = (size[:, -1] <= most) & (common[:, -1] < self.held) & there[:, -1]
                rest.append(rows[wider])
            todo, width = np.concatenate(rest), 2 * width
        return values, ends


def scan(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The ``keep`` columns and ``matches``, an array of (licence, dice, first_line, last_line), best
    first and ties by name, of every row. Null and empty texts have none. Whole texts, no shuffle;
    the templates travel with the job.
    """
    match = T.StructType(
        [
            T.StructField("licence", T.StringType()),
            T.StructField("dice", T.DoubleType()),
            T.StructField("first_line", T.IntegerType()),
            T.StructField("last_line", T.IntegerType()),
        ]
    )
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField("matches", T.ArrayType(match))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        names = ("licence", "dice", "first_line", "last_line")
        kind = pa.list_(
            pa.struct(
                [
                    ("licence", pa.string()),
                    ("dice", pa.float64()),
                    ("first_line", pa.int32()),
                    ("last_line", pa.int32()),
                ]
            )
        )
        for batch in batches:
            found = [
                [dict(zip(names, m)) for m in known.find_spans(x.as_py())]
                for x in batch.column(batch.num_columns - 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, kind)], names=schema.names
            )

    return docs.select(*keep, utf8(text).alias("_llm_text")).mapInArrow(run, schema)


def best_licence(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The best match of each row (null and 0 without one), how many places match, and the
    different licences found, sorted and comma-joined."""
    licences = F.array_sort(F.array_distinct("matches.licence"))
    return scanned.select(
        *keep,
        F.get("matches", 0)["licence"].alias("licence"),
        F.coalesce(F.get("matches", 0)["dice"], F.lit(0.0)).alias("dice"),
        F.size("matches").cast("bigint").alias("n_places"),
        F.concat_ws(",", licences).alias("licences"),
    )
