"""Inference backends: what turns an input tensor into an output tensor, made once a Python worker."""

from __future__ import annotations

import atexit
from collections.abc import Callable
from typing import Protocol

import numpy as np

from glyphmill.schemas import OcrError


class Backend(Protocol):
    def run(self, batch: np.ndarray) -> np.ndarray:
        """Rank 4 in; (n, 1, h, w) probabilities from a detector, (n, t, classes) from a recogniser."""


class BrightnessDetector:
    """A deterministic detector for tests: the map is the mean brightness of a pixel."""

    def run(self, batch: np.ndarray) -> np.ndarray:
        if batch.ndim != 4:
            raise OcrError("InvalidInputShape", "rank 4 wanted")
        return ((batch.mean(1, keepdims=True) + 1) / 2).astype(np.float32)


class ColumnRecogniser:
    """A deterministic recogniser for tests: each eighth column's brightness picks a class."""

    def __init__(self, classes: int):
        self.classes = classes

    def run(self, batch: np.ndarray) -> np.ndarray:
        if batch.ndim != 4:
            raise OcrError("InvalidInputShape", "rank 4 wanted")
        level = (batch.mean((1, 2))[:, ::8] + 1) / 2
        chosen = np.clip((level * (self.classes - 1)).round().astype(int), 0, self.classes - 1)
        out = np.full((*chosen.shape, self.classes), 0.1 / self.classes, np.float32)
        np.put_along_axis(out, chosen[..., None], 0.9, 2)
        return out


class PlaneRecogniser:
    """A deterministic recogniser for tests of colour: a line reads as the class after the number of its brightest plane."""

    def __init__(self, classes: int):
        self.classes = classes

    def run(self, batch: np.ndarray) -> np.ndarray:
        out = np.zeros((len(batch), 40, self.classes), np.float32)
        out[:, :, 0] = 0.5
        out[np.arange(len(batch)), 3, 1 + batch.mean((2, 3)).argmax(1)] = 0.9
        return out


class OnnxBackend:
    """A model file run by onnxruntime: first input, first output."""

    def __init__(self, path: str):
        import onnxruntime

        self.session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        self.input = self.session.get_inputs()[0].name

    def run(self, batch: np.ndarray) -> np.ndarray:
        if batch.ndim != 4:
            raise OcrError("InvalidInputShape", "rank 4 wanted")
        try:
            return self.session.run(None, {self.input: batch.astype(np.float32)})[0]
        except Exception as why:  # the runtime has exception types of its own
            raise OcrError("OutputError", str(why)) from why


_made: dict[tuple, Backend] = {}


def close_backends() -> None:
    """Let go of the worker's sessions; the next use makes new ones. Runs when a worker ends."""
    _made.clear()


atexit.register(close_backends)


def backend(kind: str | Callable[..., Backend], *arguments) -> Backend:
    """The worker's backend of a kind: brightness, columns or planes (classes), onnx (path), or what a class or function of one's own makes.

    What a function makes is kept by its full name, as a task gets a copy of the function.
    """
    if callable(kind):
        make, name = kind, f"{kind.__module__}.{kind.__qualname__}"
    else:
        make, name = {"brightness": BrightnessDetector, "columns": ColumnRecogniser, "planes": PlaneRecogniser, "onnx": OnnxBackend}[kind], kind
    key = (name, *arguments)
    if key not in _made:
        _made[key] = make(*arguments)
    return _made[key]
