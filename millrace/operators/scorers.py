"""Models behind the operators: closed-form stubs, and ONNX files.

A scorer is a factory without arguments; what it gives takes a list of tuples of
inputs and returns a list of outputs."""

from __future__ import annotations

from collections.abc import Callable


def stub_embedder() -> Callable:
    """Row i of a batch: [i, bytes of the text]."""
    return lambda batch: [[float(i), float(len((text or "").encode()))] for i, (text,) in enumerate(batch)]


def length_embedder() -> Callable:
    """[bytes, characters, 1] of a text, whatever its batch."""
    return lambda batch: [[float(len((t or "").encode())), float(len(t or "")), 1.0] for (t,) in batch]


def stub_reranker() -> Callable:
    """One logit: the batch's size less the row's place."""
    return lambda batch: [[float(len(batch) - i)] for i, _ in enumerate(batch)]


def overlap_reranker() -> Callable:
    """Two logits: 0, and the share of the query's words that the document has, times 4 less 2."""

    def score(query: str, text: str) -> float:
        words = set((query or "").lower().split())
        return len(words & set((text or "").lower().split())) / max(len(words), 1)

    return lambda batch: [[0.0, 4 * score(q, t) - 2] for q, t in batch]


#: Registered scorers by name.
SCORERS: dict[str, Callable[[], Callable]] = {"stub_embedder": stub_embedder, "length_embedder": length_embedder, "stub_reranker": stub_reranker, "overlap_reranker": overlap_reranker}


def onnx(path: str, prepare: Callable[[list[tuple]], dict], finish: Callable[[list], list], providers: tuple[str, ...] = ("CPUExecutionProvider",)) -> Callable[[], Callable]:
    """A scorer of an ONNX file: ``prepare`` makes the session's inputs of a batch, ``finish``
    the outputs of its results. One session a task; the file is where executors see it."""

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=list(providers))
        return lambda batch: finish(session.run(None, prepare(batch)))

    return make
