"""The registry of ingest sources. Tokens are shown once; only their SHA-256 is kept."""

from __future__ import annotations

import hashlib
import re
import secrets
import uuid
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"[\w .-]{1,64}")
_SEEN = timedelta(seconds=60)


@dataclass(frozen=True)
class Source:
    source_id: str
    name: str
    description: str
    token_sha256: str
    token_hint: str
    enabled: bool
    created_at: str
    last_seen_at: str | None = None


class Registry:
    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    @staticmethod
    def _token() -> tuple[str, str, str]:
        token = secrets.token_urlsafe(32)
        return token, hashlib.sha256(token.encode()).hexdigest(), token[-4:]

    def create(self, name: str, description: str = "") -> tuple[Source, str]:
        """The source and its token."""
        name = name.strip()
        if not _NAME.fullmatch(name):
            raise ValueError("a name has 1 to 64 letters, digits, spaces, dots, dashes or underscores")
        if any(s.name == name for s in self._sources.values()):
            raise ValueError(f"source {name} exists")
        token, digest, hint = self._token()
        made = Source(str(uuid.uuid4()), name, description, digest, hint, True, datetime.now(UTC).isoformat())
        self._sources[made.source_id] = made
        return made, token

    def all(self) -> list[Source]:
        return sorted(self._sources.values(), key=lambda s: s.name)

    def get(self, source_id: str) -> Source | None:
        return self._sources.get(source_id)

    def rotate(self, source_id: str) -> str | None:
        """A new token; the old one no longer works."""
        if source_id not in self._sources:
            return None
        token, digest, hint = self._token()
        self._sources[source_id] = replace(self._sources[source_id], token_sha256=digest, token_hint=hint)
        return token

    def update(self, source_id: str, enabled: bool | None = None, description: str | None = None) -> Source | None:
        old = self._sources.get(source_id)
        if old is not None:
            new = replace(old, enabled=old.enabled if enabled is None else enabled, description=old.description if description is None else description)
            self._sources[source_id] = new
            return new
        return None

    def delete(self, source_id: str) -> bool:
        return self._sources.pop(source_id, None) is not None

    def authenticate(self, token: str, now: datetime | None = None) -> Source | None:
        """The enabled source of a token. When it was seen is noted once a minute at most."""
        digest = hashlib.sha256(token.encode()).hexdigest()
        found = next((s for s in self._sources.values() if secrets.compare_digest(s.token_sha256, digest) and s.enabled), None)
        if found is None:
            return None
        now = now or datetime.now(UTC)
        if found.last_seen_at is None or now - datetime.fromisoformat(found.last_seen_at) >= _SEEN:
            found = replace(found, last_seen_at=now.isoformat())
            self._sources[found.source_id] = found
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """The sources without their tokens' hashes."""
        rows = [tuple(v for k, v in asdict(s).items() if k != "token_sha256") for s in self.all()]
        return spark.createDataFrame(rows, "source_id string, name string, description string, token_hint string, enabled boolean, created_at string, last_seen_at string")
