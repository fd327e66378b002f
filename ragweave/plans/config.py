"""Settings of ingestion, retrieval and evaluation, with their standard values."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
HEADINGS = ("BOOK", "CHAPTER", "SECTION", "PROP.")
REMOVED_SECTIONS = ("CONTENTS", "TABLE OF CONTENTS", "PREFACE", "INDEX", "QUESTIONS", "EXERCISES", "PROBLEMS", "APPENDIX", "BIBLIOGRAPHY", "REFERENCES")
THINKERS = (
    "mill", "jevons", "read", "atkinson", "james", "hamilton", "bain", "venn", "keynes", "beneke", "halleck", "hyslop", "brooks", "aristotle", "hobbes", "comte", "lambert", "herschel", "newton", "bacon", "de morgan", "leibnitz", "locke", "reid", "descartes",
)
CONCEPTS = (
    "syllogis", "induct", "deduct", "infer", "proposit", "premise", "conclu", "fallac", "analog", "predicat", "quantifier", "valid", "sound", "enthymem", "axiom", "dictum", "substitut", "distribut", "categor", "hypothet",
)
BRIDGES = ("vs", "versus", "compar", "contrast", "differ", "relat", "impact", "influenc", "illustrat", "modific")
REFUSAL = "could not find"


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    chunk_mode: str = "overlap"
    iteration: str = "4"
    embedding_batch: int = 100
    embedding_attempts: int = 3
    embedding_pause: float = 1.0
    embedding_timeout: int = 120
    part_chars: int = 800
    method: str = "faiss"
    top_n: int = 100
    top_k: int = 3
    threshold: float = 0.5
    min_words: int = 10
    complex_from: int = 4
    sub_queries: int = 3
    run_ingestion: bool = False
    run_generation: bool = True
    run_audit: bool = True
    strict_models: bool = False
    compat_substring_verdict: bool = False
    embedding_model: str = "embed"
    generation_model: str = "generate"
    retrieval_eval_model: str = "retrieval-eval"
    judge_model: str = "judge"
    rerank_model: str = "rerank"

    @property
    def max_size(self) -> int:
        return int(self.chunk_size * 1.5)
