"""Profile-driven generators (X4, X5) and the reference-embedding job.

A generator is a text-model client (``list[str] -> list[str | None]``)
called through :func:`matchbook.operators.scoring.call_text_model`.  The
defaults are offline, deterministic stand-ins that build their replies from
the prompt, so the whole flow runs without network.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions import dims
from matchbook.functions import text as T
from matchbook.functions.prompts import IDEAL_JOB_PROMPT, KEYWORD_PROMPT
from matchbook.operators.embedding import REF_LANGS, elementwise_mean, embed_texts
from matchbook.operators.embedding import py_tokenize
from matchbook.operators.scoring import call_text_model

# --- fixed values -----------------------------------------------------------
IDEAL_JOB_SCHEMA = "title array<string>, description array<string>"
KEYWORD_SCHEMA = "what_or string, what_exclude string"
IDEAL_JOBS_PER_PROFILE = 3      # each in French then English: 6 texts per field
N_INCLUDE_WORDS = 25
N_EXCLUDE_WORDS = 10
# ---------------------------------------------------------------------------


def profile_prompt_slots(sector_sep: str) -> dict:
    return dict(sectors=T.join_list("sectors", sector_sep), titles=T.join_list("job_titles"),
                skills=F.array_join(F.transform("technical_skills", lambda s: s["name"]), ", "),
                education=T.default(dims.education_label("education"), "unknown"),
                experience=T.default(dims.experience_label("experience"), "unknown"))


def _words(prompt: str) -> list[str]:
    return [w for w in dict.fromkeys(py_tokenize(prompt)) if len(w) > 2]


class OfflineIdealJobClient:
    """Replies ``{"title": [6], "description": [6]}`` (FR, EN alternating)
    made of the prompt's own words."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            if p is None:
                out.append(None)
                continue
            words = _words(p) or ["job"]
            titles, descs = [], []
            for i in range(IDEAL_JOBS_PER_PROFILE):
                for lang in ("fr", "en"):
                    k = int(hashlib.md5(f"{p}|{i}|{lang}".encode()).hexdigest()[:8], 16)
                    pick = [words[(k + j) % len(words)] for j in range(4)]
                    titles.append(" ".join(pick[:2]))
                    descs.append(f"{lang}: " + " ".join(pick))
            out.append(json.dumps({"title": titles, "description": descs}))
        return out


class OfflineKeywordClient:
    """Replies ``{"what_or": "25 words", "what_exclude": "10 words"}``."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            if p is None:
                out.append(None)
                continue
            words = _words(p)
            inc = words[:N_INCLUDE_WORDS]
            exc = [w[::-1] for w in words[N_INCLUDE_WORDS:N_INCLUDE_WORDS + N_EXCLUDE_WORDS]]
            out.append(json.dumps({"what_or": " ".join(inc), "what_exclude": " ".join(exc)}))
        return out


def generate_keywords(profiles: DataFrame, client=None) -> DataFrame:
    """``(user_id, what_or, what_exclude)`` per profile; malformed
    replies give NULL lists (the user then matches nothing)."""
    prompts = profiles.select("user_id", KEYWORD_PROMPT.column(**profile_prompt_slots(", ")).alias("prompt"))
    replies = call_text_model(prompts, "prompt", "user_id", client or OfflineKeywordClient())
    parsed = F.from_json("reply", KEYWORD_SCHEMA)
    return replies.select("user_id", parsed["what_or"].alias("what_or"),
                          parsed["what_exclude"].alias("what_exclude"))


def generate_ideal_jobs(profiles: DataFrame, client=None) -> DataFrame:
    """Long ``(user_id, field, lang, idx, text)``; the reply lists
    alternate French and English."""
    prompts = profiles.select("user_id", IDEAL_JOB_PROMPT.column(**profile_prompt_slots(" or ")).alias("prompt"))
    replies = call_text_model(prompts, "prompt", "user_id", client or OfflineIdealJobClient())
    parsed = replies.select("user_id", F.from_json("reply", IDEAL_JOB_SCHEMA).alias("r"))
    # both fields from the one parsed reply: the model is called once
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), F.col("r")[f].alias("texts"))
                          for f in ("title", "description")])
    long = (parsed.select("user_id", F.explode(per_field).alias("f"))
                  .select("user_id", "f.field", F.posexplode("f.texts").alias("idx", "text")))
    lang = F.when(F.col("idx") % 2 == 0, REF_LANGS[0]).otherwise(REF_LANGS[1])
    return long.withColumn("lang", lang).select("user_id", "field", "lang", "idx", "text")


def build_reference_embeddings(profiles: DataFrame, generator=None, provider=None,
                               dim: int = 64) -> DataFrame:
    """Entry 2: profile -> ideal-job texts -> vectors -> mean per (user,
    field, lang), i.e. the rows of the reference-embedding store."""
    texts = generate_ideal_jobs(profiles, generator)
    vecs = embed_texts(texts, ["user_id", "field", "lang", "idx"], "text", provider, dim)
    return elementwise_mean(vecs, ["user_id", "field", "lang"], "vec", dim=dim)
