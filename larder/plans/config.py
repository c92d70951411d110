"""Parameters of a run."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from larder.functions import vocabulary as V


@dataclass(frozen=True)
class MatchConfig:
    top_k: int = V.TOP_K
    threshold: float = V.MIN_SCORE
    model_hash: str = "stand-in"
    dense_model: str = "hashed-trigrams"
    reuse: bool = True

    def with_sidecars(self, texts: dict[str, str]) -> MatchConfig:
        """With what files beside a model say: threshold.json ({"threshold": t}) and version.txt."""
        out = self
        if "threshold.json" in texts:
            out = replace(out, threshold=float(json.loads(texts["threshold.json"])["threshold"]))
        if "version.txt" in texts:
            out = replace(out, model_hash=texts["version.txt"].strip())
        return out

    def fingerprint(self, catalog_hash: str) -> str:
        """What stored candidates depend on."""
        return f"{self.top_k}/{catalog_hash}/{self.dense_model}/name-form/rrf"
