"""The engine's configuration, checked as a whole when it's made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from quarry.operators.answering import INSTRUCTIONS
from quarry.operators.chunking import check_window
from quarry.operators.vector_index import BUILD_PARAMS, check_params

DEFAULT_BUILD = {"flat_ip": {}, "hnsw": {"m": 32, "ef_construction": 200}, "ivf_flat": {"nlist": 1024, "train_size": 100_000, "train_seed": 20260731}, "ivf_pq": {"nlist": 1024, "train_size": 100_000, "train_seed": 20260731, "m": 48, "nbits": 8}}


@dataclass(frozen=True)
class QueryPlan:
    """How one query retrieves: off means depths of 0 and no parameters; on, ``candidate_k`` is at least ``final_k``, which is over 0."""

    enabled: bool
    candidate_k: int
    final_k: int
    search: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.enabled and not 0 < self.final_k <= self.candidate_k:
            raise ValueError("final_k is over 0 and candidate_k not below it")
        if not self.enabled and (self.candidate_k or self.final_k or self.search):
            raise ValueError("a plan that doesn't retrieve has no depths and parameters")

    def with_top_k(self, top_k: int) -> "QueryPlan":
        """The plan for another ``final_k``: the candidate pool stays unless it's too small; 0 turns retrieval off."""
        if top_k == 0:
            return QueryPlan(False, 0, 0)
        return QueryPlan(True, max(self.candidate_k, top_k), top_k, self.search)


@dataclass(frozen=True)
class Config:
    chunker: str = "fixed_sentence"
    chunk_size: int = 300
    chunk_overlap: int = 50
    embedder: str = "hashing"
    model_name: str | None = None
    dimension: int = 384
    normalize: bool = True
    document_prefix: str = ""
    query_prefix: str = ""
    index: str = "flat_ip"
    index_build: dict = field(default_factory=dict)
    retrieval: str = "dense"
    final_k: int = 5
    candidate_k: int | None = None
    search: dict = field(default_factory=dict)
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    reranker: str = "none"
    context_tokens: int | None = None
    prompt: str = "fixed_qa_v1"
    generator: str = "extractive"
    max_output_tokens: int = 512
    save_retrieved_text: bool = True

    def __post_init__(self):
        one_of = {"chunker": ("fixed_sentence", "presegmented"), "embedder": ("hashing", "model"), "index": tuple(BUILD_PARAMS), "retrieval": ("dense", "bm25"), "reranker": ("none", "cross_encoder"), "prompt": tuple(INSTRUCTIONS), "generator": ("extractive", "model")}
        for name, allowed in one_of.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        check_window(self.chunk_size, self.chunk_overlap)
        if self.chunker == "presegmented" and self.chunk_overlap:
            raise ValueError("presegmented chunks don't overlap")
        check_params(self.index, self.index_build, self.search if self.retrieval == "dense" else None, self.dimension)
        if self.retrieval == "bm25" and self.search:
            raise ValueError("bm25 takes no search parameters")
        if not (1e-6 <= self.bm25_k1 <= 100 and 0 <= self.bm25_b <= 1):
            raise ValueError("bm25_k1 is from 1e-6 to 100, bm25_b from 0 to 1")
        if self.context_tokens is not None and self.context_tokens <= 0 or self.max_output_tokens <= 0 or self.dimension <= 0:
            raise ValueError("budgets and dimensions are over 0")
        if self.embedder == "model" and not self.model_name:
            raise ValueError("a model embedder has a model_name")
        self.plan()

    def space(self) -> dict:
        """What two embeddings have in common if they can be compared."""
        name = self.model_name if self.embedder == "model" else f"hashing-{self.dimension}"
        return {"backend": self.embedder, "model_name": name, "dimension": self.dimension, "normalize": self.normalize, "document_prefix": self.document_prefix, "query_prefix": self.query_prefix}

    @classmethod
    def of(cls, values: dict) -> "Config":
        """From a mapping; unknown keys and inline secrets raise."""
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def load(cls, path: str) -> "Config":
        """From a YAML file, or a JSON one, which is all that can be read without a YAML package."""
        import json

        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml
        except ModuleNotFoundError:
            return cls.of(json.loads(text))
        return cls.of(yaml.safe_load(text) or {})

    def build_params(self) -> dict:
        return DEFAULT_BUILD[self.index] | self.index_build

    def plan(self) -> QueryPlan:
        search = check_params(self.index, self.build_params() if self.index != "ivf_pq" else {k: v for k, v in self.build_params().items() if k != "m"}, self.search) if self.retrieval == "dense" else {}
        return QueryPlan(True, self.candidate_k or self.final_k, self.final_k, search)

    def recorded(self) -> dict:
        """What identities are made of: everything that changes results."""
        return {f.name: getattr(self, f.name) for f in fields(self)}
