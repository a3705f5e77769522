"""What an application plugs in: a source of files and a model, and the stand-ins for both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import prompt as PR
from quarrykit.session import table


class SourceProvider(Protocol):
    """Files as a table, so that reading one is a join and not a call."""

    def files(self) -> DataFrame:
        """file_id, repo, sha, path, content."""
        ...


class IndexStore(Protocol):
    """Where the tables of an index are kept."""

    def write(self, name: str, df: DataFrame) -> None: ...

    def read(self, name: str) -> DataFrame: ...


class ModelProvider(Protocol):
    """A model that answers prompts; many questions are answered by one plan."""

    name: str

    def complete(self, prompts: DataFrame, evidence: DataFrame) -> DataFrame:
        """question_id, raw: the reply to each prompt.  prompts: question_id, prompt; evidence as of ``prompt.stand_in``."""
        ...


@dataclass
class FolderSource:
    """The ingested files of a folder of Parquet tables."""

    spark: SparkSession
    folder: str

    def files(self) -> DataFrame:
        return table(self.spark, self.folder, "ingested_files").dropDuplicates(["file_id"]).select("file_id", "repo", "sha", "path", F.coalesce("content", F.lit("")).alias("content"))


@dataclass
class StandIn:
    """Quotes the first blocks of the evidence and understands nothing."""

    name: str = "extractive"

    def complete(self, prompts: DataFrame, evidence: DataFrame) -> DataFrame:
        return PR.stand_in(evidence)


@dataclass
class Scripted:
    """Replies given beforehand by question; a question without one fails as an unavailable model does, with a null reply."""

    replies: DataFrame  # question_id, raw
    name: str = "scripted"

    def complete(self, prompts: DataFrame, evidence: DataFrame) -> DataFrame:
        return prompts.select("question_id").join(self.replies.select("question_id", "raw"), "question_id", "left")


@dataclass
class PerRow:
    """A model behind a function from a prompt to a reply, called in Arrow batches on the executors."""

    call: Callable[[str], str]
    name: str = "function"

    def complete(self, prompts: DataFrame, evidence: DataFrame) -> DataFrame:
        call = self.call

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"question_id": b.question_id, "raw": [call(p) if p is not None else None for p in b.prompt]})

        return prompts.select("question_id", "prompt").mapInPandas(run, "question_id BIGINT, raw STRING")
