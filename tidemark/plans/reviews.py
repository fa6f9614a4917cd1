"""Repeated calls of an injected text model on one prompt, with receipts on how well the answers keep their contract."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import POSTURE, REQUIRED_NON_CLAIMS, USELESS, find_object
from ..functions.receipts import validate

RECEIPTS = "run_index int, raw_output_hash string, normalized_output_hash string, json_parse_ok boolean, schema_ok boolean, no_extra_text boolean, exact_response_type boolean, required_non_claims_present boolean, correct_authority_posture boolean, passed boolean, observation_count int, question_count int, authority_drift_count int, empty_observation_count int, duplicate_question_count int"


def _texts(values) -> list[str]:
    return [str("" if v is None else v).strip().lower() for v in (values if isinstance(values, list) else [])]


def receipt(index: int, raw: str, schema: dict, response_type: str) -> tuple:
    """One answer's receipt row."""
    found, before, after = find_object(raw)
    try:
        payload = json.loads(found) if found else None
    except ValueError:
        payload = None
    value = payload or {}
    posture = value.get("authority_posture")
    drift = sum(posture.get(k) is not v for k, v in POSTURE.items()) if isinstance(posture, dict) else len(POSTURE)
    questions = [q for q in _texts(value.get("questions")) if q]
    checks = (payload is not None, payload is not None and not validate(payload, schema), found is not None and not before.strip() and not after.strip(), value.get("response_type") == response_type, set(REQUIRED_NON_CLAIMS) <= set(_texts(value.get("non_claims"))), drift == 0)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (index, digest(raw), digest(json.dumps(payload, separators=(",", ":"), ensure_ascii=False)) if payload else None, *checks, all(checks), len(_texts(value.get("observations"))), len(_texts(value.get("questions"))), drift, sum(o in USELESS for o in _texts(value.get("observations"))), len(questions) - len(set(questions)))


def benchmark(spark: SparkSession, prompt: str, invoke: Callable[[str], str], schema: dict, response_type: str, repeat: int = 3) -> DataFrame:
    """``repeat`` fresh calls of ``invoke`` and their receipts."""
    return spark.createDataFrame([receipt(i + 1, invoke(prompt), schema, response_type) for i in range(repeat)], RECEIPTS)


#: What a model is told to do (fixed texts).
INSTRUCTIONS = (
    "Operate in read-side-only mode.",
    "Return JSON only.",
    "Use exactly these top-level keys: response_type, input_stream_id, observations, questions, non_claims, authority_posture.",
    "Do not add any other keys.",
    "Do not wrap the JSON in markdown fences.",
    "Do not use a code block.",
    "The first character of your response must be {.",
    "The last character of your response must be }.",
    "observations must be an array of strings.",
    "questions must be an array of strings.",
    "non_claims must be an array of strings.",
    "authority_posture must exactly match the required booleans shown below.",
    "substrate_handles are typed read-side refs only.",
    "Do not treat substrate_handles as runtime authority.",
    "Do not infer payload contents beyond the supplied typed refs.",
    "Do not claim canon authority.",
    "Do not claim runtime authority.",
    "Do not claim truth closure.",
    "Do not claim same-object closure.",
    "Do not claim identity closure.",
    "Do not claim promotion authority.",
    "Do not write back into runtime or substrate state.",
)


def template(response_type: str, stream_id: str | None = None) -> dict:
    """The answer that a model has to fill in."""
    claims = [c[0].upper() + c[1:] for c in REQUIRED_NON_CLAIMS]
    return {"response_type": response_type, "input_stream_id": stream_id, "observations": [" "], "questions": [" "], "non_claims": claims, "authority_posture": dict(POSTURE)}


def prompt(view: dict, response_type: str, opening: str = "You are reading a bounded input view.") -> str:
    """The whole prompt for one input view."""
    plain = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    stream = (view.get("scope") or {}).get("stream_id")
    return "\n".join([opening, *INSTRUCTIONS, "", "Return JSON matching this template:", plain(template(response_type, stream)), "", "LM input follows:", plain(view)])


def stage(spark: SparkSession, view: dict, folder: str, response_type: str, opening: str = "You are reading a bounded input view.") -> dict[str, str]:
    """Writes input, prompt and answer template of one invocation; returns their paths and the answer's."""
    from ..sources.files import write_text

    names = {"lm_input": "lm_input.json", "lm_prompt": "lm_prompt.txt", "lm_output_template": "lm_output.template.json", "lm_output": "lm_output.json"}
    paths = {k: f"{folder.rstrip('/')}/{v}" for k, v in names.items()}
    stream = (view.get("scope") or {}).get("stream_id")
    write_text(spark, paths["lm_input"], json.dumps(view, indent=2) + "\n")
    write_text(spark, paths["lm_prompt"], prompt(view, response_type, opening) + "\n")
    write_text(spark, paths["lm_output_template"], json.dumps(template(response_type, stream), indent=2) + "\n")
    return paths


def summary(receipts: DataFrame) -> DataFrame:
    """Passes, distinct answers, and whether counts were stable."""
    return receipts.agg(F.count(F.lit(1)).alias("run_count"), F.count_if("passed").alias("pass_count"), F.count_if(~F.col("passed")).alias("fail_count"), F.count_distinct("normalized_output_hash").alias("unique_normalized_output_hashes"), (F.count_distinct("observation_count") <= 1).alias("observation_count_stable"), (F.count_distinct("question_count") <= 1).alias("question_count_stable"))


def input_view(summaries: DataFrame, trajectory: DataFrame, last: int = 3) -> DataFrame:
    """What a model may see of a run: its counts and the last few pairs of adjacent states."""
    from pyspark.sql import Window

    order = Window.partitionBy("stream_id").orderBy("frame_index")
    rows = trajectory.withColumn("before", F.lag("state_id").over(order)).where("before is not null")
    newest = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("frame_index")))
    pairs = rows.withColumn("__n", newest).where(F.col("__n") <= last).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("frame_index", "before", "state_id"))).alias("handles"))
    return summaries.join(pairs, "stream_id", "left")
