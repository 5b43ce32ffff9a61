"""Extractors as table functions: `register` makes them known to SQL, where they work on rows laterally or on a partition of a table."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from . import lists


@udtf(returnType="place int, term string, char_start int")
class FindTerms:
    """find_terms(text, terms): each occurrence of a term as a whole word, in order; terms are separated by `|` and compared without case."""

    def eval(self, text: str, terms: str):
        if text and terms:
            pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(t) for t in sorted(terms.split("|"), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
            for place, m in enumerate(pattern.finditer(text)):
                yield place, m.group().lower(), m.start()


@udtf
class SpeakerRuns:
    """speaker_runs(TABLE(t) [PARTITION BY ... ORDER BY ...], by, text): successive rows of a partition with one value of `by` become one: the partition's columns, the run's number, its value of `by`, rows and words.

    Asks itself for partitioning by `group` and order by `turn` if it is given their names
    instead. Holds one run, however long the partition is.
    """

    def __init__(self, result: AnalyzeResult | None = None):
        self._group, self._by, self._text = (result.group, result.by, result.text) if result else ("", "", "")
        self._run = None
        self._number = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, group: AnalyzeArgument, turn: AnalyzeArgument, by: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument of speaker_runs is a table")
        fields = {f.name: f.dataType for f in table.dataType.fields}
        for asked in (group, turn, by, text):
            if asked.value not in fields:
                raise ValueError(f"speaker_runs: the table has no column {asked.value!r}")
        schema = T.StructType([T.StructField(group.value, fields[group.value]), T.StructField("run", T.LongType()), T.StructField(by.value, fields[by.value]), T.StructField("rows", T.LongType()), T.StructField("words", T.LongType())])
        return SpeakerResult(schema=schema, partitionBy=[PartitioningColumn(group.value)], orderBy=[OrderingColumn(turn.value)], group=group.value, by=by.value, text=text.value)

    def eval(self, row, group: str, turn: str, by: str, text: str):
        words = len((row[text] or "").split())
        if self._run is not None and self._run[2] == row[by]:
            self._run[3] += 1
            self._run[4] += words
            return
        if self._run is not None:
            yield tuple(self._run)
            self._number += 1
        self._run = [row[group], self._number, row[by], 1, words]

    def terminate(self):
        if self._run is not None:
            yield tuple(self._run)


class SpeakerResult(AnalyzeResult):
    """What the analysis found, handed on to each task."""

    def __init__(self, group: str = "", by: str = "", text: str = "", **known):
        super().__init__(**known)
        self.group, self.by, self.text = group, by, text


def register(spark: SparkSession) -> None:
    spark.udtf.register("find_terms", FindTerms)
    spark.udtf.register("speaker_runs", SpeakerRuns)
