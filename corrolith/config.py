"""Settings of the engine. Values come from arguments, else from variables of the environment, else from the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from corrolith.operators.clusters import Clustering
from corrolith.operators.recall import Visibility


@dataclass(frozen=True)
class Recall:
    max_tokens: int = 1500
    decay_days: float = 90.0
    top_k: int = 8
    steps: int = 3
    visibility: Visibility = Visibility()


@dataclass(frozen=True)
class Promotion:
    """Least number of workspaces, confidence and sessions for a domain and for all."""

    domain: tuple[int, float, int] = (2, 0.75, 2)
    everywhere: tuple[int, float, int] = (3, 0.85, 3)
    shared_entities: int = 2


@dataclass(frozen=True)
class Service:
    base_url: str = ""
    api_key: str = ""
    model: str = ""
    dim: int = 1024
    timeout: float = 60.0


@dataclass(frozen=True)
class Settings:
    root: str = ""
    recall: Recall = field(default_factory=Recall)
    promotion: Promotion = field(default_factory=Promotion)
    clustering: Clustering = field(default_factory=Clustering)
    embedding: Service = field(default_factory=Service)
    llm: Service = field(default_factory=Service)


def load(environment: dict[str, str] | None = None) -> Settings:
    """Settings from CORROLITH_ROOT, CORROLITH_MAX_TOKENS, CORROLITH_DECAY_DAYS and CORROLITH_EMBEDDING_* and CORROLITH_LLM_*
    (BASE_URL, API_KEY, MODEL, DIM, TIMEOUT)."""
    env = os.environ if environment is None else environment
    get = lambda name, kind, otherwise: kind(env[f"CORROLITH_{name}"]) if env.get(f"CORROLITH_{name}") else otherwise

    def service(prefix: str) -> Service:
        base = Service()
        return replace(base, **{f.name: get(f"{prefix}_{f.name.upper()}", type(getattr(base, f.name)), getattr(base, f.name)) for f in fields(Service)})

    recall = Recall(get("MAX_TOKENS", int, 1500), get("DECAY_DAYS", float, 90.0))
    return Settings(root=get("ROOT", str, ""), recall=recall, embedding=service("EMBEDDING"), llm=service("LLM"))
