"""What a published table was made from: hashes bound together and verified."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession

from ..operators.gates import GateError
from .readers import file_hashes


def digest(document: dict) -> str:
    """sha256 over a document with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()


def bundle(spark: SparkSession, parts: dict[str, str], identity: dict) -> dict:
    """The hashes of the parts' files (a short list) with the ids that must agree, and one hash over all."""
    files = {name: sorted((r["path"].rsplit("/", 1)[-1], r["sha256"]) for r in file_hashes(spark, path).collect()) for name, path in parts.items()}
    body = {"files": files, "identity": identity}
    return body | {"bundle_id": digest(body)}


def verify(spark: SparkSession, made: dict, parts: dict[str, str]) -> None:
    """Raises if a part is not what it was when the bundle was made, or the bundle was changed."""
    if digest({k: made[k] for k in ("files", "identity")}) != made["bundle_id"]:
        raise GateError("the bundle itself was changed")
    now = bundle(spark, parts, made["identity"])
    changed = [n for n in parts if [list(x) for x in now["files"][n]] != [list(x) for x in made["files"].get(n, [])]]
    if changed:
        raise GateError(f"changed since: {changed}")


def supersede(old: dict, new: dict, reason: str | None) -> dict:
    """new as the successor of old, the lineage carried on; needs a reason and a difference."""
    if not reason:
        raise GateError("a plan is replaced for a reason")
    if all(old.get(k) == new.get(k) for k in ("roster_hash", "items_hash", "arms")):
        raise GateError("the new plan is the old one")
    return new | {"supersedes": old["id"], "reason": reason, "history": [*old.get("history", []), old["id"]]}
