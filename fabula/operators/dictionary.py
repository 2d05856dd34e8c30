"""Which labels of a dictionary are in texts: whole phrases by an Aho-Corasick automaton, single
words by their stems.

Labels go to tasks in blocks of bounded size, a pass over the texts for each block;
a text is read once for all labels of a block, whatever their lengths.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from fabula.functions import text as T
from fabula.plans.storage import materialize

#: Characters of labels that go to tasks at once; one label may be longer.
BLOCK_CHARS = 8_000_000
_CYRILLIC_END = re.compile(r"[^ ]*[а-яё](?= |$)")
_STEM = re.compile(rf"^(.{{4,}}?)(?:{'|'.join(T.STEM_SUFFIXES)})$", re.DOTALL)


def stem(word: str) -> str:
    """As functions.text.stem_token has it."""
    return _STEM.sub(r"\1", word) if _CYRILLIC_END.fullmatch(word) else word


class Dictionary:
    """Labels in normalized form with their numbers."""

    def __init__(self, labels: list[tuple[int, str]]):
        self.phrases, self.words = ahocorasick.Automaton(), {}
        self.stems: defaultdict[str, list[int]] = defaultdict(list)
        for number, label in labels:
            if " " in label:
                self.phrases.add_word(f" {label} ", number)
            else:
                self.words[label] = number
                self.stems[stem(label)].append(number)
        self.phrases.make_automaton()

    def find(self, text: str) -> tuple[set[int], set[int]]:
        """The labels that are in a normalized text as they are, and those of which only a stem is."""
        tokens = set(text.split(" "))
        whole = {self.words[w] for w in tokens & self.words.keys()}
        if len(self.phrases):
            whole |= {number for _, number in self.phrases.iter(f" {text} ")}
        if not text.isascii():
            cyrillic = set(_CYRILLIC_END.findall(text))
            tokens = (tokens - cyrillic) | {stem(w) for w in cyrillic}
        stemmed = {n for s in tokens & self.stems.keys() for n in self.stems[s]}
        return whole, stemmed - whole


def _blocks(labels: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in labels.toLocalIterator():
        if block and size + len(row.l) > most:
            yield block
            block, size = [], 0
        block.append((row.number, row.l))
        size += len(row.l)
    if block:
        yield block


def find_labels(texts: DataFrame, labels: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, number, whole) for each label (number, l) in a text; ``whole`` where it is there as it is, not
    by its stem alone. ``l`` is normalized and not empty; texts are normalized here, null has no labels."""
    kind = texts.schema[id_col].dataType
    schema = StructType([StructField(id_col, kind), StructField("number", LongType()), StructField("whole", BooleanType())])
    rows = texts.select(id_col, T.scene_text(F.col(text_col)).alias("t")).where("t <> ''")

    def search(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Dictionary(block)  # built where it is used: once for each task
            for batch in batches:
                at, numbers, wholes = [], [], []
                for i, text in enumerate(batch.column(1)):
                    whole, stemmed = known.find(text.as_py())
                    at += [i] * (len(whole) + len(stemmed))
                    numbers += [*whole, *stemmed]
                    wholes += [True] * len(whole) + [False] * len(stemmed)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int64()), pa.array(wholes, pa.bool_())], names=[id_col, "number", "whole"])

        return rows.mapInArrow(run, schema)

    out, several = None, False
    for block in _blocks(labels, block_chars):
        found = search(block)
        if out is not None:  # so that no plan holds more than one block
            out = (out if several else materialize(out, "label-hits")).union(materialize(found, "label-hits"))
            several = True
        else:
            out = found
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)
