"""Run configuration (driver side)."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from urllib.parse import urlsplit


@dataclass
class Config:
    """Settings of a run; :meth:`check` names everything that is wrong with them at once."""

    username: str = ""
    api_token: str = ""
    seeds: list[str] = field(default_factory=list)
    max_depth: int = 3
    concurrency: int = 5
    requests_per_minute: int = 250
    max_queue: int = 10_000
    follow_children: bool = False
    output_dir: str = "output"
    download_attachments: bool = False
    max_attachment_mb: int = 100
    max_retries: int = 5
    initial_backoff_ms: int = 1000
    post_hook: list[str] = field(default_factory=list)
    post_hook_enabled: bool = False

    @classmethod
    def from_text(cls, text: str, environ: dict[str, str] | None = None) -> Config:
        """Settings from JSON, or from YAML where a YAML reader is installed."""
        if not text.lstrip().startswith("{"):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("settings that are not JSON need a YAML reader") from e
            text = json.dumps(yaml.safe_load(text) or {})
        return cls.from_json(text, environ)

    @classmethod
    def from_json(cls, text: str, environ: dict[str, str] | None = None) -> Config:
        """Settings from JSON; non-empty WIKI_USERNAME and WIKI_API_TOKEN win over it."""
        env = os.environ if environ is None else environ
        config = cls(**json.loads(text))
        config.username = env.get("WIKI_USERNAME") or config.username
        config.api_token = env.get("WIKI_API_TOKEN") or config.api_token
        return config

    def errors(self) -> list[str]:
        found = [f"{name} is required" for name in ("username", "api_token", "output_dir") if not getattr(self, name).strip()]
        if not self.seeds:
            found.append("at least one seed is required")
        for seed in self.seeds:
            parts = urlsplit(seed.strip())
            if not (parts.scheme and parts.netloc):
                found.append(f"seed {seed!r} is not a URL with scheme and host")
        if self.max_depth < 0:
            found.append("max_depth must not be negative")
        found += [f"{name} must be positive" for name in ("concurrency", "requests_per_minute", "max_queue") if getattr(self, name) <= 0]
        found += [f"{name} must be at least 1" for name in ("max_retries", "initial_backoff_ms") if getattr(self, name) < 1]
        if self.post_hook_enabled and not hook_command(self.post_hook):
            found.append("post_hook needs a command")
        return found

    def check(self) -> None:
        if found := self.errors():
            raise ValueError("; ".join(found))

    def base_url(self) -> str:
        """Scheme and host of the first seed, with its first path segment where the path has two or more."""
        parts = urlsplit(self.seeds[0].strip())
        segments = [s for s in parts.path.split("/") if s]
        return f"{parts.scheme}://{parts.netloc}" + (f"/{segments[0]}" if len(segments) >= 2 else "")


def hook_command(argv: list[str]) -> list[str]:
    """Arguments stripped, blank ones dropped."""
    return [a.strip() for a in argv if a.strip()]
