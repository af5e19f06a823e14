"""Assessments of findings: offline providers, what an assessment must look like, and a store of those that were made. Nothing is sent anywhere."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from corvane.functions.text import FINGERPRINT
from corvane.sources.reports import checked_document, write_atomically

# What an assessment may say, and its bounds.
STATUSES = ("supported", "questioned", "contradicted", "insufficient-evidence")
TEXTS = ("evidence_assessment", "confidence_explanation", "remediation_proposal", "uncertainty")
LISTS = ("prerequisites", "verification_suggestions", "limitations")
MAX_TEXT, MAX_ITEMS, MAX_ENTRY, FORMAT = 4_096, 32, 1 << 20, 1


def problem(assessment: dict) -> str | None:
    """Why a document is no assessment, or null. What its texts say is data, whatever it asks for."""
    if not isinstance(assessment, dict) or set(assessment) - {"status", *TEXTS, *LISTS}:
        return "unknown or no fields"
    if assessment.get("status") not in STATUSES:
        return "status"
    for name in TEXTS:
        if not isinstance(assessment.get(name), str) or len(assessment[name].encode()) > MAX_TEXT:
            return name
    for name in LISTS:
        items = assessment.get(name)
        if not isinstance(items, list) or len(items) > MAX_ITEMS or any(not isinstance(x, str) or len(x.encode()) > MAX_TEXT for x in items):
            return name
    return None


@dataclass(frozen=True)
class Provider:
    """name, kind, and the answer to a payload. Both kinds work offline."""

    name: str
    kind: str
    answer: Callable[[str], dict]


def mock(status: str = "insufficient-evidence") -> Provider:
    text = {name: "no assessment was made" for name in TEXTS}
    return Provider("mock", "deterministic", lambda payload: {"status": status} | text | {name: [] for name in LISTS})


def recorded(path: str) -> Provider:
    body = checked_document(path)
    return Provider(os.path.basename(path), "recorded", lambda payload: body)


def providers() -> list[dict[str, str]]:
    return [{"name": "mock", "kind": "deterministic"}, {"name": "recorded", "kind": "recorded"}]


def key_of(finding: dict, payload: str, provider: Provider) -> str:
    parts = [finding["finding_id"], finding["fingerprint"], payload, provider.name, provider.kind]
    return hashlib.sha256("".join(f"{len(p.encode())}:{p}" for p in parts).encode()).hexdigest()


class AssessmentCache:
    """A file an assessment, named by its content key; the oldest go where the folder is over its budget; what can't be read is retired."""

    def __init__(self, folder: str, budget: int = 64 << 20):
        if not os.path.isabs(folder):
            raise ValueError("the folder must be absolute")
        os.makedirs(folder, mode=0o700, exist_ok=True)
        self.folder, self.budget = folder, budget

    def _path(self, key: str) -> str:
        if not re.match(FINGERPRINT, key):
            raise ValueError(f"not a key: {key!r}")
        return os.path.join(self.folder, f"{key}.json")

    def load(self, key: str) -> dict | None:
        path = self._path(key)
        if not os.path.lexists(path):
            return None
        try:
            entry = checked_document(path, MAX_ENTRY)
            if entry.get("format") == FORMAT and entry.get("key") == key and problem(entry.get("assessment")) is None:
                return entry["assessment"]
        except (OSError, ValueError):
            pass
        os.replace(path, f"{path}.corrupt")
        return None

    def store(self, key: str, assessment: dict) -> None:
        if wrong := problem(assessment):
            raise ValueError(f"no assessment: {wrong}")
        write_atomically(self._path(key), json.dumps({"format": FORMAT, "key": key, "assessment": assessment}, sort_keys=True))
        files = sorted(((f.stat().st_mtime_ns, f.name, f.stat().st_size, f.path) for f in os.scandir(self.folder) if f.name.endswith(".json") and f.is_file(follow_symlinks=False)), reverse=True)
        total = 0
        for _, _, size, path in files:
            total += size
            if total > self.budget:
                os.unlink(path)

    def clear(self) -> int:
        files = [f.path for f in os.scandir(self.folder) if f.name.endswith((".json", ".corrupt"))]
        for path in files:
            os.unlink(path)
        return len(files)


def assess(finding: dict, payload: str, provider: Provider, cache: AssessmentCache | None = None) -> dict:
    """The provider's assessment of a finding, from the cache if it was made before; an error if it is none."""
    key = key_of(finding, payload, provider)
    found = cache.load(key) if cache else None
    if found is None:
        found = provider.answer(payload)
        if wrong := problem(found):
            raise ValueError(f"no assessment: {wrong}")
        if cache:
            cache.store(key, found)
    return {"finding_id": finding["finding_id"], "fingerprint": finding["fingerprint"], "verdict": found["status"], "assessment": found}
