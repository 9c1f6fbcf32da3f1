"""Models behind small interfaces, with deterministic offline defaults.

An encoder turns texts into vectors of unit length, a reranker scores a passage against a query, a generator answers a
prompt. The defaults need no model: hashed tokens, token F1 and a template. Vectors from real models plug in the same
way; results of those can't be compared with the defaults' numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scoring import token_f1


def hash_vector(text: str | None, dim: int) -> list[float]:
    """Signed counts of hashed tokens, of unit length."""
    v = [0.0] * dim
    for t in (text or "").lower().split():
        h = hashlib.md5(t.encode()).digest()
        v[int.from_bytes(h[:4], "little") % dim] += 1.0 if h[4] & 1 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


@dataclass(frozen=True)
class HashingEncoder:
    dim: int = 64

    def encode(self, text: str) -> list[float]:
        return hash_vector(text, self.dim)

    def column(self, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield b.map(lambda t: hash_vector(t, dim))

        return df.withColumn(out, encode(F.col(text)))

    def sparse(self, text: Column) -> Column:
        """Lexical weights: share of each token."""
        words = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
        kinds = F.array_distinct(words)
        return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(words, lambda w: w == k)) / F.size(words)))


def encoder_name(encoder) -> str:
    """A folder name that differs for encoders with different settings."""
    settings = repr(getattr(encoder, "name", encoder))
    return f"{type(encoder).__name__.lower()}-{hashlib.md5(settings.encode()).hexdigest()[:8]}"


def pick_device(wanted: str = "auto", present: Callable[[str], bool] | None = None) -> str:
    """The wanted device if it is present, else cuda, mps or cpu, whichever is present first."""

    def seen(device: str) -> bool:
        try:
            import torch
        except ImportError:
            return False
        return torch.cuda.is_available() if device.startswith("cuda") else device == "mps" and torch.backends.mps.is_available()

    present = present or seen
    order = ([] if wanted == "auto" else [wanted]) + ["cuda", "mps"]
    return next((d for d in order if d == "cpu" or present(d)), "cpu")


_loaded: dict[tuple[str, str], Callable[[list[str]], list[list[float]]]] = {}


@dataclass(frozen=True)
class ModelEncoder:
    """Vectors of a model that every worker loads once, when its first batch comes.

    ``load`` takes a device and gives a function from texts to vectors; it has to be importable on the workers. If loading or
    encoding fails on another device, the CPU is tried. ``unit`` scales vectors to length one.
    """

    name: str
    load: Callable[[str], Callable[[list[str]], list[list[float]]]]
    device: str = "auto"
    unit: bool = True

    def _call(self, texts: list[str]) -> list[list[float]]:
        device = pick_device(self.device)
        for d in dict.fromkeys((device, "cpu")):
            try:
                key = (self.name, d)
                if key not in _loaded:
                    _loaded[key] = self.load(d)
                rows = [[float(x) for x in v] for v in _loaded[key](texts)]
                break
            except RuntimeError:  # what devices raise when they lack memory or kernels
                if d == "cpu":
                    raise
        if not self.unit:
            return rows
        sizes = [sum(x * x for x in v) ** 0.5 for v in rows]
        return [[x / n for x in v] if n else v for v, n in zip(rows, sizes, strict=True)]

    def encode(self, text: str) -> list[float]:
        return self._call([text])[0]

    def column(self, df: DataFrame, text: str, out: str = "vec", block: int = 64) -> DataFrame:
        call = self._call

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                texts = [t or "" for t in b]
                yield pd.Series([v for i in range(0, len(texts), block) for v in call(texts[i : i + block])], index=b.index, dtype=object)

        return df.withColumn(out, encode(F.col(text)))


@dataclass(frozen=True)
class ModelSpec:
    """One row of the registry: how a model is loaded and called.

    ``kind`` is 'encoder' (a function from texts to vectors) or 'reranker' (from (query, passage) pairs to scores). Prefixes go before queries and
    documents; ``unit`` scales vectors to length one.
    """

    key: str
    kind: str
    load: Callable[[str], Callable[[list], list]]
    query_prefix: str = ""
    document_prefix: str = ""
    unit: bool = True
    batch: int = 64
    device: str = "auto"


class ModelRegistry:
    """Registered models behind one call: a column names each row's model, and one plan uses as many as there are.

    Rows of a model are brought together within each partition, so that a worker loads a model once and keeps few of them:
    ``keep`` at most, the last used ones. A device that fails gives way to the CPU. With ``profile``, a resource profile, tasks
    run where its devices are.
    """

    def __init__(self, specs: list[ModelSpec], keep: int = 2):
        self.specs, self.keep = {s.key: s for s in specs}, keep
        if len(self.specs) < len(specs):
            raise ValueError("a model is registered twice")

    def spec(self, key: str, kind: str) -> ModelSpec:
        if key not in self.specs or self.specs[key].kind != kind:
            raise KeyError(f"no {kind} {key!r}; there are {', '.join(sorted(k for k, s in self.specs.items() if s.kind == kind)) or 'none'}")
        return self.specs[key]

    def call(self, key: str, kind: str, rows: list) -> list:
        """What a model gives for rows, in its batches."""
        spec = self.spec(key, kind)
        out: list = []
        for i in range(0, len(rows), spec.batch):
            out += self._batch(spec, rows[i : i + spec.batch])
        if kind == "encoder" and spec.unit:
            sizes = [sum(float(x) * float(x) for x in v) ** 0.5 for v in out]
            out = [[float(x) / n for x in v] if n else [float(x) for x in v] for v, n in zip(out, sizes, strict=True)]
        return out

    def _batch(self, spec: ModelSpec, rows: list) -> list:
        for device in dict.fromkeys((pick_device(spec.device), "cpu")):
            at = (f"{spec.kind}:{spec.key}", device)
            try:
                if at not in _loaded:
                    mine = [k for k in _loaded if ":" in k[0]]
                    for k in mine[: max(0, len(mine) - self.keep + 1)]:
                        del _loaded[k]
                    _loaded[at] = spec.load(device)
                else:
                    _loaded[at] = _loaded.pop(at)  # last used
                return list(_loaded[at](rows))
            except RuntimeError:  # what devices raise when they lack memory or kernels
                _loaded.pop(at, None)
                if device == "cpu":
                    raise
        raise AssertionError

    def encode(self, text: str, model: str, as_query: bool = True) -> list[float]:
        spec = self.spec(model, "encoder")
        return self.call(model, "encoder", [(spec.query_prefix if as_query else spec.document_prefix) + text])[0]

    def vectors(self, df: DataFrame, text: str, model: str = "model", out: str = "vec", as_query: bool = False, profile=None) -> DataFrame:
        """``df`` with the vector of each text by the model that its column ``model`` names; null texts are empty ones."""
        prefix = {k: s.query_prefix if as_query else s.document_prefix for k, s in self.specs.items()}
        one = lambda key, b: self.call(key, "encoder", [prefix.get(key, "") + (t or "") for t in b[text]])
        return self._mapped(df, model, out, "array<float>", one, profile)

    def scores(self, df: DataFrame, query: str, passage: str, model: str = "model", out: str = "rerank_score", profile=None) -> DataFrame:
        """``df`` with the score of each passage for its query by the model that its column ``model`` names."""
        one = lambda key, b: [float(x) for x in self.call(key, "reranker", [(q or "", p or "") for q, p in zip(b[query], b[passage], strict=True)])]
        return self._mapped(df, model, out, "double", one, profile)

    def _mapped(self, df: DataFrame, model: str, out: str, kind: str, one: Callable, profile) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = pd.Series([None] * len(b), index=b.index, dtype=object)
                for key in b[model].unique():
                    rows = b.index[b[model] == key]
                    for i, v in zip(rows, one(key, b.loc[rows]), strict=True):
                        found.at[i] = v
                yield b.assign(**{out: found})

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out), f"`{out}` {kind}"])
        near = df.drop(out).sortWithinPartitions(model)
        return near.mapInPandas(run, schema, profile=profile) if profile is not None else near.mapInPandas(run, schema)

    def encoder(self, key: str) -> RegisteredEncoder:
        self.spec(key, "encoder")
        return RegisteredEncoder(self, key)

    def reranker(self, key: str) -> RegisteredReranker:
        self.spec(key, "reranker")
        return RegisteredReranker(self, key)


@dataclass(frozen=True, repr=False)
class RegisteredEncoder:
    """One encoder of a registry, with the interface of the others: queries get its query prefix, columns its document prefix."""

    registry: ModelRegistry
    name: str

    def encode(self, text: str) -> list[float]:
        return self.registry.encode(text, self.name)

    def column(self, df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        return self.registry.vectors(df.withColumn("_model", F.lit(self.name)), text, "_model", out).drop("_model")


@dataclass(frozen=True, repr=False)
class RegisteredReranker:
    registry: ModelRegistry
    name: str

    def score(self, query: str | Column, passage: Column) -> Column:
        registry, name = self.registry, self.name

        @F.pandas_udf("double")
        def ask(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, p in pairs:
                yield pd.Series([float(x) for x in registry.call(name, "reranker", [(a or "", b or "") for a, b in zip(q, p, strict=True)])], index=q.index, dtype=float)

        return ask(F.lit(query) if isinstance(query, str) else query, passage)


def ndjson(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Objects of a stream of JSON lines that comes in pieces of any length; blank and broken lines, and lines of other values, are passed over."""
    rest = b""
    for piece in chain(pieces, [b"\n"]):
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            try:
                found = json.loads(line) if line.strip() else None
            except ValueError:  # also bytes that are no UTF-8
                continue
            if isinstance(found, dict):
                yield found


class TokenStream:
    """Tokens of an answer as they come, and afterwards what the call was: ``call`` is a row that ``plans.answer.envelope`` takes."""

    def __init__(self, pieces: Iterable[bytes], model: str = ""):
        self.pieces, self.call = pieces, {"response": "", "fallback_used": False, "model": model, "eval_tokens": 0, "prompt_tokens": 0, "duration_ns": 0, "error": ""}

    def __iter__(self) -> Iterator[str]:
        c, parts = self.call, []
        try:
            for x in ndjson(self.pieces):
                message = x.get("message")
                text = message.get("content", "") if isinstance(message, dict) else x.get("response", "")
                if isinstance(text, str) and text:
                    parts.append(text)
                    yield text
                if x.get("error"):
                    c["error"] = str(x["error"])
                if x.get("done"):
                    c |= {"model": x.get("model") or c["model"], "eval_tokens": int(x.get("eval_count") or 0), "prompt_tokens": int(x.get("prompt_eval_count") or 0), "duration_ns": int(x.get("total_duration") or 0)}
        except OSError as e:
            c["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            c["response"] = "".join(parts)


@dataclass(frozen=True)
class HttpGenerator:
    """A language model behind a chat service that streams JSON lines."""

    url: str
    model: str
    system: str = ""
    temperature: float = 0.0
    max_tokens: int = 1024
    timeout: float = 120.0

    def open(self, prompt: str) -> TokenStream:
        messages = [*([{"role": "system", "content": self.system}] if self.system else []), {"role": "user", "content": prompt}]
        body = {"model": self.model, "messages": messages, "stream": True, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}}
        request = Request(f"{self.url.rstrip('/')}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})

        def pieces() -> Iterator[bytes]:
            with urlopen(request, timeout=self.timeout) as r:
                while data := r.read1(1 << 14):
                    yield data

        return TokenStream(pieces(), self.model)

    def stream(self, prompt: str) -> Iterator[str]:
        return iter(self.open(prompt))

    def answer(self, prompt: str) -> str:
        return "".join(self.open(prompt))


@dataclass(frozen=True)
class LexicalReranker:
    def score(self, query: str | Column, passage: Column) -> Column:
        return token_f1(passage, F.lit(query) if isinstance(query, str) else query)


@dataclass(frozen=True)
class TemplateGenerator:
    """Answers with the first lines of the prompt; stands in for a language model."""

    lines: int = 3

    def answer(self, prompt: str) -> str:
        return "\n".join([x for x in prompt.splitlines() if x.strip()][: self.lines])

    def stream(self, prompt: str) -> Iterator[str]:
        for word in self.answer(prompt).split(" "):
            yield word + " "


def with_fallback(calls: list[Callable[[str], str]], prompt: str) -> str | None:
    """The first call that succeeds; None if none does."""
    for call in calls:
        try:
            return call(prompt).strip()
        except Exception:  # any failure of a provider leads to the next one
            continue
    return None


@dataclass(frozen=True)
class Providers:
    encoder: HashingEncoder = HashingEncoder()
    reranker: LexicalReranker | None = LexicalReranker()
    generator: TemplateGenerator = TemplateGenerator()
    #: Language models by name, where there are any: parsing, refining, compressing and answering go to the tier's or the task's model.
    models: Callable[[str], HttpGenerator] | None = None
    registered: frozenset[str] = frozenset()
