"""One configuration object; environment variables override its defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Folders below ``root``, limits and defaults of the engine."""

    root: str = "./data"
    top_k: int = 50
    rerank_k: int = 10
    strategy: str = "hybrid+filter+rerank"
    ontology_threshold: float = 0.65
    context_tokens: int = 2000
    max_file_gb: float = 5.0
    min_samples: int = 1
    max_results: int = 20
    qc_min_genes: int = 200
    qc_min_cells: int = 3
    qc_max_mito_percent: float = 20.0
    tier: str = ""
    default_model: str = "qwen2.5-1.5b"

    def path(self, name: str) -> str:
        """Folder of a table: landed, series, studies, ontology, index, manifests, matrices or themes."""
        return f"{self.root.rstrip('/')}/{name}"


def load_config(prefix: str = "QUARRY_", env: dict[str, str] | None = None, path: str | None = None) -> Config:
    """Defaults, then a YAML or JSON file of the same names, then the environment."""
    env = dict(os.environ) if env is None else env
    given = {}
    if path:
        import yaml

        known = {f.name for f in fields(Config)}
        given = {k: v for k, v in (yaml.safe_load(Path(path).read_text()) or {}).items() if k in known}
    for f in fields(Config):
        raw = env.get(prefix + f.name.upper())
        if raw is not None:
            given[f.name] = {"int": int, "float": float}.get(f.type, str)(raw)
    return Config(**given)


def log_file(folder: str, name: str = "quarry") -> str:
    """Log to a file and the console; returns the file's path."""
    import logging
    import time

    Path(folder).mkdir(parents=True, exist_ok=True)
    path = str(Path(folder) / f"{name}-{time.strftime('%Y%m%d-%H%M%S')}.log")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s", handlers=[logging.FileHandler(path), logging.StreamHandler()], force=True)
    return path
