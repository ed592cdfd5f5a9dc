"""Settings of a retrieval: immutable, with builders and presets."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from ..operators.filters import MetadataFilter

MODES = ("dense", "sparse", "hybrid")


@dataclass(frozen=True)
class RerankerConfig:
    enabled: bool = False
    top_n: int = 20
    top_k: int = 5


@dataclass(frozen=True)
class HybridConfig:
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    candidates: int = 20
    rrf_k: int = 60


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "dense"
    top_k: int = 5
    reranker: RerankerConfig = field(default_factory=RerankerConfig)
    hybrid: HybridConfig = field(default_factory=HybridConfig)
    metadata_filter: MetadataFilter | None = None
    filter_mode: str = "post"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.filter_mode not in ("post", "pre"):
            raise ValueError(f"unknown filter mode {self.filter_mode!r}")
        if self.top_k < 1:
            raise ValueError("top_k is 1 at least")

    def with_reranking(self, top_n: int = 20, top_k: int = 5) -> RetrievalConfig:
        return replace(self, reranker=RerankerConfig(True, top_n, top_k), top_k=top_k)

    def with_metadata_filter(self, **conditions) -> RetrievalConfig:
        return replace(self, metadata_filter=MetadataFilter(**conditions))

    def with_hybrid(self, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> RetrievalConfig:
        return replace(self, mode="hybrid", hybrid=HybridConfig(dense_weight, sparse_weight))


@dataclass(frozen=True)
class Settings:
    """Where things lie, by default below one folder; no setting is required."""

    dense_kind: str = "parquet"
    dense_path: str = "index/dense"
    sparse_path: str = "index/bm25"
    artifacts: str = "artifacts"
    samples: str = "evaluation"

    @classmethod
    def load(cls, environ: dict[str, str], folder: str = ".", prefix: str = "SPARQUILL_") -> Settings:
        """Settings of an environment, as SPARQUILL_DENSE_PATH; blank ones count as unset, relative paths are below ``folder``."""
        given = {f: environ.get(prefix + f.upper(), "").strip() or d for f, d in ((f.name, f.default) for f in fields(cls))}
        return cls(**{f: v if f == "dense_kind" or "://" in v or v.startswith("/") else f"{folder}/{v}" for f, v in given.items()})


BASELINE = RetrievalConfig()
RERANKED = RetrievalConfig().with_reranking()
HYBRID = RetrievalConfig().with_hybrid()
HYBRID_RERANKED = RetrievalConfig().with_hybrid().with_reranking()
