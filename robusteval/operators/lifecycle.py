"""What guards a stage: frozen inputs, pinned revisions, earlier validations."""

from __future__ import annotations

import re
from collections.abc import Mapping

from robusteval import constants as C

STAGES = ("smoke", "pilot", "confirmatory")
#: Splits whose validation a stage needs.
NEEDS = {"smoke": ("smoke",), "pilot": ("smoke", "pilot"), "confirmatory": ("confirmatory",)}


def pinned(revision: str | None, resolved: Mapping[str, str] | None = None, artifact: str | None = None) -> str:
    """The immutable revision asked for or resolved earlier; else an error."""
    for r in (revision, (resolved or {}).get(artifact or "")):
        if r and re.fullmatch(C.REVISION, r):
            return r
    raise RuntimeError(f"{artifact or 'artifact'} has no immutable revision")


def stage_errors(stage: str, validations: Mapping[str, bool], revisions: Mapping[str, str | None], locked: bool, audit_passed: bool | None = None) -> list[str]:
    """What stops a stage, as messages; none lets it start."""
    if stage not in STAGES:
        raise ValueError(f"no stage named {stage!r}")
    errors = [] if locked else ["the manifest is not frozen"]
    for artifact, revision in sorted(revisions.items()):
        if not revision or not re.fullmatch(C.REVISION, revision):
            errors.append(f"{artifact} has no immutable revision")
    errors += [f"{split} rewordings are not validated" for split in NEEDS[stage] if not validations.get(split)]
    if stage == "confirmatory":
        if audit_passed is None:
            errors.append("the semantic audit is unavailable")
        elif not audit_passed:
            errors.append("the semantic audit is incomplete, uncertain or below its rate")
    return errors


def refuse_existing(exists: bool, force: bool, what: str) -> None:
    """Frozen things are replaced only by force."""
    if exists and not force:
        raise FileExistsError(f"{what} exists; it is frozen")


def check_arguments(protocol: str, split: str, attempt: int = 1, most: int = C.MAX_ATTEMPTS) -> None:
    if protocol == "controlled" and split != "pilot":
        raise ValueError("the controlled protocol runs on the pilot split only")
    if not 1 <= attempt <= most:
        raise ValueError(f"attempt must be 1 to {most}")


#: What a run uses artifacts for, in order of staging; a group is a use, one of GROUPS, or all.
USES = ("primary", "generator", "judge", "external", "embedding")
GROUPS = {"main": ("primary",), "rewording": ("generator", "judge"), "transfer": ("external",), "intervention": ("primary", "embedding")}


def artifacts(group: str, config: Mapping[str, list[tuple[str, str, str | None]]]) -> list[tuple[str, str, str | None]]:
    """(kind, id, revision) of the artifacts that a group stages, each once, from those
    the config has by kind of use."""
    uses = (*USES, *config) if group == "all" else GROUPS.get(group, (group,))
    if group not in GROUPS and group != "all" and group not in config:
        raise ValueError(f"no group named {group!r}")
    return list(dict.fromkeys(a for use in uses for a in config.get(use, [])))
