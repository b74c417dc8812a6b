"""Model providers behind one protocol, with deterministic offline ones; and request limits by provider."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from embedlake.operators.batching import batch_indices, estimated_tokens


class Provider(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def call(self, task: str, request: dict) -> dict: ...


@dataclass(frozen=True)
class Limits:
    """Chunks and tokens a request; None: no limit."""

    chunks: int = 2048
    tokens: float | None = None


#: Limits of the providers; fixed values.
LIMITS = {
    "openai": Limits(2048, 300_000), "ollama": Limits(2048), "voyageai": Limits(128, 120_000), "hash": Limits(2048), "sentence_transformers": Limits(2048),
    "litellm/cohere": Limits(96), "litellm/openai": Limits(2048, 600_000), "litellm/azure": Limits(2048, 600_000), "litellm/huggingface": Limits(2048), "litellm/bedrock": Limits(96),
    "litellm/gemini": Limits(250), "litellm/vertex_ai": Limits(250, 20_000), "litellm/mistral": Limits(128, 16_000), "litellm/voyage": Limits(128),
}
#: Token limits of single models; fixed values.
VOYAGE_TOKENS = {"voyage-3.5-lite": 1_000_000, "voyage-3-lite": 1_000_000, "voyage-3.5": 320_000, "voyage-2": 320_000, "voyage-3": 320_000}
UNKNOWN = Limits(5)
#: Tokens that an OpenAI embedding model takes of a text.
OPENAI_CONTEXT = 8191
#: How rank files of such models cut texts before merging; a fixed value.
SPLIT_PATTERN = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=8)
def truncation(model: str | None, tokenizer: str | None, most: int):
    """A function that cuts a text to at most ``most`` tokens of the model.

    ``tokenizer`` is a rank file; without one the model's own encoding is asked for, which needs a network once.
    Texts of at most ``most`` bytes never have more tokens and need neither; a longer one raises where the encoding
    can't be had, so that what is embedded doesn't depend on the machine.
    """

    @functools.cache
    def coder():
        import tiktoken

        if tokenizer:
            from tiktoken.load import load_tiktoken_bpe

            return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=load_tiktoken_bpe(tokenizer), special_tokens={})
        try:
            return tiktoken.encoding_for_model(model)
        except Exception as e:  # no such model, or no network
            raise ValueError(f"no encoding for the model {model!r}, which a text of more than {most} bytes has to be cut by: name a rank file as tokenizer") from e

    def cut(text: str) -> str:
        if len(text.encode()) <= most:
            return text
        own = coder()
        ids = own.encode_ordinary(text)
        return text if len(ids) <= most else own.decode_bytes(ids[:most]).decode("utf-8", "ignore")

    return cut


def limits(config: dict) -> Limits:
    kind, model = config["implementation"], config.get("model", "")
    if kind == "litellm":
        return LIMITS.get(f"litellm/{model.split('/')[0]}", UNKNOWN)
    if kind == "voyageai":
        return Limits(128, VOYAGE_TOKENS.get(model, 120_000))
    if kind == "ollama":
        return Limits(int(os.environ.get("EMBEDLAKE_OLLAMA_MAX_CHUNKS", "2048")))
    return LIMITS[kind]


def hash_vector(text: str, dimensions: int) -> list[float]:
    """A vector from MD5 digests: component i is the first 32 bits of md5(text:i), scaled to -1..1."""
    return [int(hashlib.md5(f"{text}:{i}".encode()).hexdigest()[:8], 16) / 2147483647.5 - 1 for i in range(dimensions)]


@dataclass
class HashProvider:
    """Offline: digests for vectors, and rules for the other tasks."""

    dimensions: int = 16
    flagged: tuple[str, ...] = ("kill", "hate", "attack")

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [hash_vector(t, self.dimensions) for t in texts]

    def call(self, task: str, request: dict) -> dict:
        text = str(request.get("input") or request.get("prompt") or "")
        if task == "moderate":
            hit = {w: w in text.lower() for w in self.flagged}
            return {"id": "offline", "model": "rules", "results": [{"flagged": any(hit.values()), "categories": hit, "category_scores": {w: float(h) for w, h in hit.items()}}]}
        if task == "tokenize":
            return {"tokens": list(text.encode())}
        if task == "detokenize":
            return {"text": bytes(request["tokens"]).decode("utf-8", "replace")}
        if task == "classify":
            return {"classifications": [self._class(x, request["examples"]) for x in request["inputs"]]}
        if task == "rerank":
            scored = sorted(((overlap(request["query"], d), -k) for k, d in enumerate(request["documents"])), reverse=True)[: request.get("top_n")]
            return {"results": [{"index": -k, "document": request["documents"][-k], "relevance_score": s} for s, k in scored], "total_tokens": sum(len(d.split()) for d in request["documents"])}
        if task == "list_models":
            return {"models": [{"id": "hash", "created": "1970-01-01T00:00:00Z", "owned_by": "offline"}]}
        answer = f"{len(text.split())} words"
        if request.get("messages"):
            answer = str(request["messages"][-1].get("content"))
        return {"id": "offline", "choices": [{"index": 0, "message": {"role": "assistant", "content": answer}}], "response": answer}

    @staticmethod
    def _class(text: str, examples: list) -> dict:
        """The label of the example that shares the most words."""
        best = max(enumerate(examples), key=lambda e: (overlap(e[1]["text"], text), -e[0]), default=None)
        label = best[1]["label"] if best else None
        return {"input": text, "prediction": label, "confidence": overlap(best[1]["text"], text) if best else 0.0}


def overlap(a: str, b: str) -> float:
    """Share of the distinct words of ``a`` that ``b`` has."""
    x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    return len(x & y) / len(x) if x else 0.0


#: Where each provider's requests go by default, by task; fixed values.
ENDPOINTS = {
    "openai": {"": "https://api.openai.com/v1", "embed": "/embeddings", "chat": "/chat/completions", "moderate": "/moderations", "list_models": "/models"},
    "ollama": {"": "http://localhost:11434", "embed": "/api/embed", "chat": "/api/chat", "generate": "/api/generate", "list_models": "/api/tags", "ps": "/api/ps"},
    "voyageai": {"": "https://api.voyageai.com/v1", "embed": "/embeddings", "rerank": "/rerank"},
    "cohere": {"": "https://api.cohere.com/v1", "embed": "/embed", "chat": "/chat", "rerank": "/rerank", "classify": "/classify", "tokenize": "/tokenize", "detokenize": "/detokenize", "list_models": "/models"},
    "anthropic": {"": "https://api.anthropic.com/v1", "generate": "/messages", "list_models": "/models"},
    "litellm": {"": "http://localhost:4000", "embed": "/embeddings", "chat": "/chat/completions"},
}
KEY_NAMES = {"openai": "OPENAI_API_KEY", "voyageai": "VOYAGE_API_KEY", "cohere": "COHERE_API_KEY", "anthropic": "ANTHROPIC_API_KEY"}


def api_key(kind: str, explicit: str | None = None, name: str | None = None, secrets: dict[str, str] | None = None) -> str | None:
    """A key by precedence: given, named secret, the provider's default name."""
    if explicit:
        return explicit
    for n in (name, KEY_NAMES.get(kind)):
        if n and (found := (secrets or {}).get(n) or os.environ.get(n)):
            return found
    return None


@dataclass
class HttpProvider:
    """A provider's JSON interface, with retries."""

    kind: str
    config: dict = field(default_factory=dict)
    key: str | None = None
    retries: int = 3

    def call(self, task: str, request: dict) -> dict:
        ends = ENDPOINTS[self.kind]
        if task not in ends:
            raise ValueError(f"{self.kind} has no {task}")
        url = (self.config.get("base_url") or ends[""]).rstrip("/") + ends[task]
        head = {"Content-Type": "application/json"}
        if self.key:
            head |= {"x-api-key": self.key, "anthropic-version": "2023-06-01"} if self.kind == "anthropic" else {"Authorization": f"Bearer {self.key}"}
        body = None if task in ("list_models", "ps") else json.dumps({k: v for k, v in request.items() if v is not None}).encode()
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=120) as r:
                    return json.loads(r.read())
            except OSError as e:
                # an answer of the 400s is the same next time, but for those that say "later"
                if k == self.retries or (isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in (408, 429)):
                    raise
                time.sleep(self.config.get("retry_seconds", 1.0) * 2**k)
        raise AssertionError

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        c = self.config
        if self.kind == "openai":
            cut = truncation(c.get("model"), c.get("tokenizer"), OPENAI_CONTEXT)
            texts = [cut(t) for t in texts]
        request: dict[str, Any] = {"model": c.get("model"), "input": list(texts)}
        if self.kind == "cohere":
            request = {"model": c.get("model"), "texts": list(texts), "input_type": c.get("input_type")}
        if self.kind == "openai" and c.get("model") != "text-embedding-ada-002":
            request["dimensions"] = c.get("dimensions")
        request |= {k: c[k] for k in ("input_type", "output_dimension", "output_dtype", "user", "options", "keep_alive") if c.get(k) is not None}
        got = self.call("embed", request)
        if "embeddings" in got:
            return got["embeddings"]
        return [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]


#: Makers of providers by implementation; applications may add their own.
REGISTRY: dict[str, Any] = {"hash": lambda config, key: HashProvider(config.get("dimensions", 16))}
for _kind in ENDPOINTS:
    REGISTRY[_kind] = lambda config, key, kind=_kind: HttpProvider(kind, config, key)


def _sentences(config: dict, key: str | None):
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(config["model"], trust_remote_code=True)

    class Local:
        def embed(self, texts):
            return [[float(v) for v in x] for x in model.encode(list(texts))]

        def call(self, task, request):
            raise ValueError(f"sentence_transformers has no {task}")

    return Local()


REGISTRY["sentence_transformers"] = _sentences


def provider(config: dict, secrets: dict[str, str] | None = None) -> Provider:
    kind = config["implementation"]
    if kind == "openai" and config.get("model") == "text-embedding-ada-002" and config.get("dimensions") not in (None, 1536):
        raise ValueError("dimensions must be 1536 for text-embedding-ada-002")
    return REGISTRY[kind](config, api_key(kind, config.get("api_key"), config.get("api_key_name"), secrets))


def embed_batches(source: Provider, texts: Sequence[str], within: Limits) -> list[list[float]]:
    """Vectors of all texts, in requests within limits; as many as texts, or it raises."""
    out: list[list[float]] = []
    for a, b in batch_indices([estimated_tokens(t) for t in texts], within.chunks, within.tokens):
        got = source.embed(texts[a:b])
        if len(got) != b - a:
            raise ValueError(f"{b - a} texts gave {len(got)} embeddings")
        out += got
    return out


def embed_each(source: Provider, texts: Sequence[str], within: Limits) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text, in requests within limits; a request that fails costs its own texts only."""
    out: list[tuple[list[float] | None, str | None]] = []
    for a, b in batch_indices([estimated_tokens(t) for t in texts], within.chunks, within.tokens):
        try:
            got = source.embed(texts[a:b])
            if len(got) != b - a:
                raise ValueError(f"{b - a} texts gave {len(got)} embeddings")
            out += [(v, None) for v in got]
        except Exception as e:
            out += [(None, f"{type(e).__name__}: {e}"[:2000])] * (b - a)
    return out
