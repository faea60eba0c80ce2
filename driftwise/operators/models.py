"""Encoders read from a folder: ``model.onnx`` and ``tokenizer.json``, as sentence encoders are commonly exported.

The folder lies where all executors can open it; nothing is downloaded. Every
Python worker loads the model once. On a cluster with GPUs a task uses the one
that Spark assigned to it (``spark.task.resource.gpu.amount``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark import TaskContext

MODEL, TOKENIZER = "model.onnx", "tokenizer.json"
MOST_TOKENS = 512
#: Files beside a model and their entries that tell how many tokens it takes.
LIMITS = (("tokenizer_config.json", "model_max_length"), ("config.json", "max_position_embeddings"))


def model_folder(path: str) -> Path:
    folder = Path(path)
    missing = [n for n in (MODEL, TOKENIZER) if not (folder / n).is_file()]
    if missing:
        raise FileNotFoundError(f"{folder}: no {', '.join(missing)}")
    return folder


def max_tokens(path: str, most: int = MOST_TOKENS) -> int:
    """The tokens a model takes at once, as its files tell, ``most`` at most."""
    found = [most]
    for name, entry in LIMITS:
        file = Path(path) / name
        value = json.loads(file.read_text("utf-8")).get(entry) if file.is_file() else None
        found += [int(value)] if value else []
    return min(found)


def providers(device: str = "auto", available: list[str] | None = None) -> list:
    """Where to run: ``cpu``, ``cuda`` (an error without one) or ``auto``, which takes a GPU if there is one."""
    if available is None:
        import onnxruntime

        available = onnxruntime.get_available_providers()
    cpu, gpu = "CPUExecutionProvider", "CUDAExecutionProvider"
    if device not in ("auto", "cpu", "cuda"):
        raise ValueError(f"unknown device: {device}")
    if device == "cuda" and gpu not in available:
        raise RuntimeError("no CUDA device for the encoder")
    if device == "cpu" or gpu not in available:
        return [cpu]
    context = TaskContext.get()
    own = context.resources().get("gpu") if context else None
    return [(gpu, {"device_id": int(own.addresses[0]) if own else 0}), cpu]


class FileTokenizer:
    """A model's own tokens, as the pieces of the text they stand for; pieces put together are the text again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(str(path))
        self.own.no_truncation()
        self.own.no_padding()

    def ids(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def tokens(self, text: str) -> list[str]:
        out, at = [], 0
        for _, end in self.own.encode(text, add_special_tokens=False).offsets:
            end = max(at, end)
            out.append(text[at:end])
            at = end
        if out:
            out[-1] += text[at:]
        return out

    def text(self, tokens: list[str]) -> str:
        return "".join(tokens)


class OnnxEncoder:
    """Unit vectors of texts: the mean over a text's tokens of what the model gives, or what it gives per text.

    A text is cut at ``most`` tokens, so chunks should be made by
    ``FileTokenizer`` with room for special tokens. A text without tokens is all zeros.
    """

    def __init__(self, path: str, device: str = "auto", most: int | None = None, threads: int = 1):
        import onnxruntime
        from tokenizers import Tokenizer

        folder = model_folder(path)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        self.session = onnxruntime.InferenceSession(str(folder / MODEL), options, providers=providers(device))
        self.inputs = [i.name for i in self.session.get_inputs()]
        self.tokenizer = Tokenizer.from_file(str(folder / TOKENIZER))
        self.tokenizer.enable_truncation(most or max_tokens(path))
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> np.ndarray:
        encodings = self.tokenizer.encode_batch([t or "" for t in texts])
        width = max((len(e.ids) for e in encodings), default=0)
        shape = (len(texts), max(1, width))
        fields = {n: np.zeros(shape, np.int64) for n in ("input_ids", "attention_mask", "token_type_ids")}
        for row, e in enumerate(encodings):
            for name, values in (("input_ids", e.ids), ("attention_mask", e.attention_mask), ("token_type_ids", e.type_ids)):
                fields[name][row, : len(values)] = values
        made = np.asarray(self.session.run(None, {n: fields[n] for n in self.inputs})[0], np.float32)
        mask = fields["attention_mask"].astype(np.float32)
        if made.ndim == 3:
            made = (made * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
        made = made * (mask.sum(1, keepdims=True) > 0)
        norms = np.linalg.norm(made, axis=1, keepdims=True)
        return np.divide(made, norms, out=np.zeros_like(made), where=norms > 0)


def vector_width(path: str) -> int:
    return OnnxEncoder(path, "cpu").encode([""]).shape[1]


def loaders(path: str, device: str = "auto", most: int | None = None) -> tuple[Callable[[], OnnxEncoder], Callable[[], FileTokenizer], int]:
    """What ``embed.embedded`` asks for: makers of the encoder and the tokenizer, and the tokens a call takes.

    The folder is looked at here, so a wrong path fails before any task starts.
    """
    folder = str(model_folder(path))
    most = most or max_tokens(folder)
    return (lambda: OnnxEncoder(folder, device, most)), (lambda: FileTokenizer(f"{folder}/{TOKENIZER}")), most
