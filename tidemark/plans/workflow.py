"""A file-backed workflow of role passes over a subject: checkpoint, permissions, transitions, JSON-lines log.

A driver-side state machine; ``illegal`` checks whole tables of responses
against the same transition table.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: States, where the machine stops, which role a state waits for, and what each role may do (fixed values).
STATES = ("seeded", "tension_held", "compressed", "gate_pending", "released", "hold", "metastable_hold", "deferred", "downgraded", "rebound", "archived")
TERMINAL = ("released", "metastable_hold", "deferred", "downgraded", "archived", "hold")
NEXT_ROLE = {"seeded": "constructor", "rebound": "constructor", "tension_held": "reflector", "compressed": "reflector", "gate_pending": "auditor_gate"}
MAY_MUTATE = {"constructor": True, "reflector": True, "creative": False, "auditor_gate": False}
TRANSITIONS = {
    ("constructor", "seeded"): ("tension_held", "compressed", "gate_pending"),
    ("constructor", "rebound"): ("tension_held", "compressed", "gate_pending"),
    ("reflector", "tension_held"): ("tension_held", "compressed", "gate_pending"),
    ("reflector", "compressed"): ("compressed", "gate_pending"),
    ("creative", "tension_held"): ("tension_held", "gate_pending"),
    ("creative", "compressed"): ("compressed", "gate_pending"),
    ("auditor_gate", "gate_pending"): ("released", "metastable_hold", "deferred", "rebound", "compressed", "hold"),
}


class WorkflowError(RuntimeError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def next_role(state: str) -> str | None:
    return "admin_router" if state in TERMINAL else NEXT_ROLE.get(state)


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [(role, before, after) for (role, before), afters in TRANSITIONS.items() for after in afters]
    return spark.createDataFrame(rows, "role string, state_before string, state_after string")


def illegal(responses: DataFrame) -> DataFrame:
    """Responses whose role may not take the state where it says."""
    return responses.join(transition_table(responses.sparkSession), ["role", "state_before", "state_after"], "left_anti")


def within(root: Path, relative: str) -> Path:
    path = (root / relative).resolve()
    if not path.is_relative_to(root.resolve()):
        raise WorkflowError("FORBIDDEN_WRITE_ZONE", f"{relative} leaves the root")
    return path


def _section(text: str, anchor: str) -> tuple[int, int] | None:
    head = re.search(rf"^(#{{1,6}})\s+{re.escape(anchor)}\s*$", text, re.M)
    if not head:
        return None
    begin = text.find("\n", head.start()) + 1 or len(text)
    following = re.search(rf"^#{{1,{len(head[1])}}}\s+", text[begin:], re.M)
    return begin, begin + following.start() if following else len(text)


def section(text: str, anchor: str) -> str:
    """The text under a heading, up to the next of its level or above."""
    span = _section(text, anchor)
    return text[span[0] : span[1]].strip() if span else ""


def replace_section(text: str, anchor: str, new: str) -> str:
    span = _section(text, anchor)
    if span is None:
        raise WorkflowError("SECTION_NOT_FOUND", anchor)
    return text[: span[0]] + new.rstrip() + "\n" + text[span[1] :]


class Workflow:
    """One subject's run: ``dispatch`` a request, ``respond`` to it, ``consume`` the response, until a terminal state."""

    def __init__(self, root: str | Path) -> None:
        self.root = Path(root).resolve()
        self.active, self.inbox, self.outbox = (self.root / d for d in ("active", "inbox", "outbox"))

    @classmethod
    def create(cls, root: str | Path, subject: dict, surface: str) -> Workflow:
        made = cls(root)
        if subject.get("state") not in STATES:
            raise WorkflowError("INVALID_SUBJECT", f"unknown state {subject.get('state')!r}")
        path = within(made.root, subject["live_surface_path"])
        for d in (made.active, made.inbox, made.outbox, path.parent):
            d.mkdir(parents=True, exist_ok=True)
        made._write("active_subject", subject)
        made._write("checkpoint", {"status": "ready", "subject_id": subject["subject_id"], "state": subject["state"], "role": next_role(subject["state"]), "pass_index": 0, "pass_id": None, "halt_reason": None})
        (made.active / "cycle_log.jsonl").write_text("")
        path.write_text(surface)
        return made

    def _read(self, name: str) -> dict:
        return json.loads((self.active / f"{name}.json").read_text())

    def _write(self, name: str, value: dict) -> None:
        (self.active / f"{name}.json").write_text(json.dumps(value, indent=2) + "\n")

    @property
    def checkpoint(self) -> dict:
        return self._read("checkpoint")

    def log(self) -> list[dict]:
        return [json.loads(x) for x in (self.active / "cycle_log.jsonl").read_text().splitlines()]

    def halt(self, code: str, message: str) -> None:
        self._write("checkpoint", self.checkpoint | {"status": "halted", "halt_reason": f"{code}: {message}"})
        raise WorkflowError(code, message)

    def interrupt(self, reason: str = "manual interrupt") -> None:
        self._write("checkpoint", self.checkpoint | {"status": "interrupted", "halt_reason": reason})

    def resume(self) -> None:
        if (status := self.checkpoint["status"]) in ("halted", "completed"):
            raise WorkflowError(f"RUNNER_{status.upper()}", f"cannot resume a {status} run")
        self._write("checkpoint", self.checkpoint | {"status": "ready", "halt_reason": None})

    def dispatch(self) -> dict:
        """The next pass's request, written to the outbox."""
        point, subject = self.checkpoint, self._read("active_subject")
        if point["status"] != "ready":
            raise WorkflowError(f"RUNNER_{'NOT_READY' if point['status'] == 'awaiting_response' else point['status'].upper()}", point["halt_reason"] or point["status"])
        pass_id = f"pass_{point['pass_index'] + 1:03d}"
        text = within(self.root, subject["live_surface_path"]).read_text()
        request = {"pass_id": pass_id, "role": point["role"], "active_subject_id": subject["subject_id"], "state_before": point["state"], "scope": {k: subject.get(k) for k in ("live_surface_path", "section_anchor", "forbidden_write_zones")}, "current_candidate_text": section(text, subject.get("section_anchor", ""))}
        (self.outbox / f"{point['role']}_request.json").write_text(json.dumps(request, indent=2))
        self._write("checkpoint", point | {"status": "awaiting_response", "pass_index": point["pass_index"] + 1, "pass_id": pass_id})
        return request

    def respond(self, response: dict) -> None:
        """Puts a role's response into the inbox."""
        if response.get("role") != self.checkpoint["role"]:
            self.halt("UNEXPECTED_ROLE_RESPONSE", f"expected {self.checkpoint['role']}, got {response.get('role')}")
        if missing := [k for k in ("pass_id", "role", "active_subject_id", "state_before", "state_after") if not isinstance(response.get(k), str)]:
            self.halt("INVALID_RESPONSE_SCHEMA", ", ".join(missing))
        (self.inbox / f"{response['role']}_response.json").write_text(json.dumps(response, indent=2))

    def consume(self) -> dict:
        """Checks the expected response, applies its text, logs it and moves to its state."""
        point, subject = self.checkpoint, self._read("active_subject")
        if point["status"] != "awaiting_response":
            raise WorkflowError("RUNNER_NOT_AWAITING_RESPONSE", point["status"])
        path = self.inbox / f"{point['role']}_response.json"
        if not path.exists():
            raise WorkflowError("MISSING_RESPONSE", path.name)
        response = json.loads(path.read_text())
        for code, key, want in (("PASS_ID_MISMATCH", "pass_id", point["pass_id"]), ("SUBJECT_MISMATCH", "active_subject_id", subject["subject_id"]), ("STATE_MISMATCH", "state_before", point["state"])):
            if response[key] != want:
                self.halt(code, f"expected {want}, got {response[key]}")
        if response["state_after"] not in TRANSITIONS.get((point["role"], point["state"]), ()):
            self.halt("ILLEGAL_STATE_TRANSITION", f"{point['role']}: {point['state']} to {response['state_after']}")
        if (new := response.get("new_text")) is not None:
            if not MAY_MUTATE[point["role"]]:
                self.halt("FORBIDDEN_MUTATION", f"{point['role']} may not write")
            surface = within(self.root, subject["live_surface_path"])
            surface.write_text(replace_section(surface.read_text(), subject["section_anchor"], new))
        role = next_role(response["state_after"])
        if "recommended_next_role" in response and response["recommended_next_role"] != role:
            self.halt("ILLEGAL_NEXT_ROLE", f"expected {role}, got {response['recommended_next_role']}")
        with (self.active / "cycle_log.jsonl").open("a") as log:
            log.write(json.dumps({k: response[k] for k in ("pass_id", "role", "active_subject_id", "state_before", "state_after")} | {"next_role": role}) + "\n")
        done = point["role"] == "auditor_gate" or role in (None, "admin_router")
        self._write("checkpoint", point | {"state": response["state_after"], "role": None if done else role, "status": "completed" if done else "ready"})
        return response
