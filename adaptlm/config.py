"""Tunables of the operators."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults that queries use."""

    snippet_prior: float = 100.0  # Dirichlet mass for ranking results
    history_prior: float = 1.0  # Dirichlet mass for searching history
    background_share: float = 0.9  # share of the background in the mixture
    query_weight: float = 1.0
    clicked_weight: float = 1.0
    unclicked_weight: float = 0.01
    min_cosine: float = 0.01
    max_neighbours: int = 10
    query_prior: float = 0.1
    background_prior: float = 0.9
    em_tries: int = 1
    em_iterations: int = 20
    click_prior: float = 1.0
    expiration_s: int = 1800
    session_gap_s: int = 1800
    session_similarity: float = 0.05
    stop_similarity: float = 0.1
    topic_sessions: int = 3
    recommend_similarity: float = 0.2
    model_terms: int = 20
    model_min_prob: float = 0.001
    promote: int = 3
    page_size: int = 10
    max_start: int = 1000


def read_settings(text: str) -> dict[str, str]:
    """name = value lines; # starts a comment; blanks, tabs and carriage returns around both are trimmed."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.partition("#")[0].partition("=")
        if eq and name.strip():
            out[name.strip()] = value.strip()
    return out


def settings_from(values: dict[str, str]) -> Settings:
    """Settings with the given values, cast to their kinds; other names are ignored."""
    kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    return Settings(**{k: kinds[k](v) for k, v in values.items() if k in kinds})
