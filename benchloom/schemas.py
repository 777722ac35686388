"""Column lists of the published tables."""

from __future__ import annotations

from .operators.grading import FAITHFULNESS, QUALITY

CORPUS = ("id", "language", "title", "abstract", "description", "first_claim", "context", "publication_number", "country_code", "publication_date", "source", "ipc_codes")
SIMPLE_QA = ("corpus_id", "language", "question", "answer")
TRACKING = ("variant", "concept_chebi_id", "concept_name", "original_term", "replacement_term", "anchor_language", "target_language", "source_id", "source_publication_number")
LADDER_TRACKING = ("base_id", "n_replacements", "anchor_language", "source_publication_number", "question_concept_chebi_id", "question_concept_name", "question_original_term", "replacements_json")

_GRADES = (*(f"faith_{c}" for c in FAITHFULNESS), "faith_overall")
_QUALITY = {mode: (*(f"qual_{c}" for c in criteria), "qual_overall") for mode, criteria in QUALITY.items()}
_PAIR = ("corpus_id", "publication_number", "question_language", "context_language", "question", "answer")


def graded_qa(mode: str) -> tuple[str, ...]:
    """Columns of graded pairs of one mode (19)."""
    kind = "question_type" if mode == "technical" else "framing"
    return (*_PAIR, kind, *_GRADES, *_QUALITY[mode], "qual_failure_type", "total_score")


def balanced_qa() -> tuple[str, ...]:
    """Columns of graded pairs of both modes together: 29, of which the two that both modes have come once."""
    both = tuple(dict.fromkeys((*_QUALITY["technical"], *_QUALITY["semantic_retrieval"])))
    return ("mode", "strategy", "strategy_name", *_PAIR, "question_type", "framing", *_GRADES, *both, "qual_failure_type", "total_score")


def concept_qa() -> tuple[str, ...]:
    """Columns of graded pairs about concepts (26)."""
    return (
        *("chebi_id", "concept_name", "mode", "strategy", "strategy_name", *_PAIR[:4], "question", "answer", "answer_language", "question_type"),
        *(*_GRADES, *_QUALITY["technical"], "qual_failure_type", "total_score", "gold_publication_count"),
    )
