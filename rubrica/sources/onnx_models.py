"""Exported transformer models as engines: a sentence encoder and a pair classifier.

Model and tokenizer files must be readable on every executor, by path or shipped with
``spark.sparkContext.addFile``.  ``onnxruntime`` and ``tokenizers`` are imported in the tasks
only, once per task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.operators.features import Embedder, PairModel, model_tasks
from rubrica.session import materialize

# Windows handed on at a time.
WINDOW_ROWS = 1024

# Names of the padding token in common vocabularies.
PAD_TOKENS = ("<pad>", "[PAD]")


def _path(name: str) -> str:
    return name if os.path.exists(name) else SparkFiles.get(os.path.basename(name))


class _Runner:
    """A model with its tokenizer; texts of any length, cut into overlapping windows of ``max_length`` tokens."""

    def __init__(self, model: str, tokenizer: str, max_length: int, batch_size: int):
        import onnxruntime
        from tokenizers import Tokenizer

        self.words = Tokenizer.from_file(_path(tokenizer))
        self.words.no_truncation()
        pad = next((t for t in PAD_TOKENS if self.words.token_to_id(t) is not None), PAD_TOKENS[-1])
        self.words.enable_padding(pad_id=self.words.token_to_id(pad) or 0, pad_token=pad)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # one task slot, one core
        self.session = onnxruntime.InferenceSession(_path(model), options, providers=["CPUExecutionProvider"])
        self.wanted = {i.name for i in self.session.get_inputs()}
        self.max_length, self.batch_size = max_length, batch_size

    def run(self, texts: list):
        """First model output and mask, a batch of windows at a time."""
        for start in range(0, len(texts), self.batch_size):
            encoded = self.words.encode_batch(texts[start : start + self.batch_size])
            mask = np.array([e.attention_mask for e in encoded], dtype=np.int64)
            feed = {
                "input_ids": np.array([e.ids for e in encoded], dtype=np.int64),
                "attention_mask": mask,
                "token_type_ids": np.array([e.type_ids for e in encoded], dtype=np.int64),
            }
            yield self.session.run(None, {k: v for k, v in feed.items() if k in self.wanted})[0], mask

    def _room(self, pair: bool) -> int:
        return max(1, self.max_length - self.words.num_special_tokens_to_add(pair))

    def _slices(self, text: str, pieces: int) -> list[str]:
        """The text in ``pieces`` parts of equal tokens, each with an eighth of its neighbours on either side."""
        places = self.words.encode(text, add_special_tokens=False).offsets
        if pieces == 1 or not places:
            return [text] * pieces
        width = len(places) / pieces
        found = []
        for k in range(pieces):
            first = min(len(places) - 1, max(0, int(k * width - width / 8)))
            last = max(first + 1, min(len(places), int(np.ceil((k + 1) * width + width / 8))))
            found.append(text[places[first][0] : places[last - 1][1]])
        return found

    def _tokens(self, text: str) -> int:
        return len(self.words.encode(text, add_special_tokens=False).offsets)

    def windows(self, *texts: str) -> list:
        """Windows of a text, or aligned windows of two texts that the model reads together."""
        total, room = sum(map(self._tokens, texts)), self._room(len(texts) > 1)
        pieces = 1 if total <= room else int(np.ceil(1.25 * total / room))
        slices = [self._slices(t, pieces) for t in texts]
        return slices[0] if len(slices) == 1 else list(zip(*slices, strict=True))


def _cut_to_rows(key: str, load, columns: list[str]):
    """A task function: a row per window of the text columns of a row, numbered."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = load()
        for batch in batches:
            rows = []
            for own, *texts in batch[[key, *columns]].itertuples(index=False):
                for k, window in enumerate(runner.windows(*texts)):
                    rows.append((own, k, *((window,) if isinstance(window, str) else window)))
                    if len(rows) == WINDOW_ROWS:
                        yield pd.DataFrame(rows, columns=[key, "window", *columns])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[key, "window", *columns])

    return cut


def _window_rows(df: DataFrame, key: str, columns: list[str], load) -> DataFrame:
    """Windows as rows, so that the windows of one long text go to many tasks."""
    schema = f"{key} binary, window int, " + ", ".join(f"{c} string" for c in columns)
    return materialize(df.mapInPandas(_cut_to_rows(key, load, columns), schema), "windows")


def onnx_embedder(model: str, tokenizer: str, max_length: int = 128, batch_size: int = 8) -> Embedder:
    """Unit-length sentence vectors: the mean of the token states over all windows of the text.

    Windows are rows of their own; a window gives the mean of its states and its number of tokens, and
    these are pooled by text.
    """

    def load():
        return _Runner(model, tokenizer, max_length, batch_size)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = load()
        for batch in batches:
            start = 0
            for out, mask in runner.run(batch["text"].tolist()):
                tokens = mask.sum(axis=1)
                mean = (out * mask[:, :, None]).sum(axis=1) / np.maximum(tokens, 1)[:, None]
                keys = batch["id"].iloc[start : start + len(tokens)].tolist()
                start += len(tokens)
                yield pd.DataFrame({"id": keys, "tokens": tokens.astype(float), "mean": list(mean.astype(float))})

    def embed(texts: DataFrame) -> DataFrame:
        windows = model_tasks(_window_rows(texts, "id", ["text"], load))
        seen = windows.mapInPandas(states, "id binary, tokens double, mean array<double>")
        pooled = seen.groupBy("id").agg(
            Summarizer.mean(array_to_vector("mean"), F.greatest("tokens", F.lit(1e-9))).alias("pooled")
        )
        unit = Normalizer(inputCol="pooled", outputCol="unit").transform(pooled)
        return unit.select("id", vector_to_array("unit", "float32").alias("vector"))

    return embed


def onnx_pair_model(
    model: str, tokenizer: str, labels: Sequence[str], max_length: int = 256, batch_size: int = 8
) -> PairModel:
    """Class logits of premise and hypothesis.

    A pair longer than ``max_length`` tokens is read in windows: both texts are cut into the same number of
    overlapping parts, part meets part as a row of its own, and the logits are the mean over a pair's windows.
    """

    def load():
        return _Runner(model, tokenizer, max_length, batch_size)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner = load()
        for batch in batches:
            texts = list(zip(batch["premise"], batch["hypothesis"], strict=True))
            logits = [row for out, _ in runner.run(texts) for row in out.astype(float)]
            yield pd.DataFrame({"pair_id": batch["pair_id"].tolist(), "logits": logits})

    def predict(pairs: DataFrame) -> DataFrame:
        windows = model_tasks(_window_rows(pairs, "pair_id", ["premise", "hypothesis"], load))
        seen = windows.mapInPandas(classify, "pair_id binary, logits array<double>")
        mean = seen.groupBy("pair_id").agg(Summarizer.mean(array_to_vector("logits")).alias("mean"))
        return mean.select("pair_id", vector_to_array("mean").alias("logits"))

    return PairModel(predict, tuple(labels))
