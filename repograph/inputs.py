"""Requests with their bounds; a value out of bounds raises ValueError, an unknown field TypeError."""

from __future__ import annotations

from dataclasses import dataclass, fields

FORMATS = ("markdown", "json")


def _text(name: str, value, least: int, most: int) -> None:
    if not isinstance(value, str) or not least <= len(value) <= most:
        raise ValueError(f"{name} must be a text of {least} to {most} characters")


def _number(name: str, value, least: int, most: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
        raise ValueError(f"{name} must be a whole number from {least} to {most}")


@dataclass(frozen=True, kw_only=True)
class Request:
    path: str = "."
    response_format: str = "markdown"

    #: Least and most, of a text's length or of a number.
    LIMITS = {"path": (1, 4096), "query": (2, 500), "target": (1, 1024), "symbol": (2, 256), "max_files": (1, 200_000), "limit": (1, 100), "max_depth": (1, 10)}

    def __post_init__(self) -> None:
        if self.response_format not in FORMATS:
            raise ValueError(f"response_format must be one of {', '.join(FORMATS)}")
        for f in fields(self):
            if f.name in self.LIMITS:
                (_number if f.name in ("max_files", "limit", "max_depth") else _text)(f.name, getattr(self, f.name), *self.LIMITS[f.name])


@dataclass(frozen=True, kw_only=True)
class IndexRequest(Request):
    max_files: int = 50_000


@dataclass(frozen=True, kw_only=True)
class SearchRequest(Request):
    query: str
    limit: int = 20


@dataclass(frozen=True, kw_only=True)
class ImpactRequest(Request):
    target: str
    max_depth: int = 5


@dataclass(frozen=True, kw_only=True)
class StatusRequest(Request):
    pass


@dataclass(frozen=True, kw_only=True)
class ReferencesRequest(Request):
    symbol: str


@dataclass(frozen=True, kw_only=True)
class DefinitionRequest(Request):
    symbol: str
