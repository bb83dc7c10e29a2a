"""Every threshold that more than one operator shares."""

from dataclasses import dataclass

from folioscope import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    cycle_percentile: float = 0.50
    cycle_floor: float = 1_000.0
    max_leg_ratio: float = 1.3
    min_cycle_nodes: int = 3
    max_cycle_nodes: int = 8
    proof_min_leg: float = 1.0
    payment_gap: float = 1.0
    income_percentile: float = 0.75
    income_floor: float = 5_000.0
    max_edits: int = 2
    generic_terms: tuple = fv.GENERIC_TERMS
    vague_terms: tuple = fv.VAGUE_TERMS
    profile_stop_words: tuple = fv.PROFILE_STOP_WORDS
    document_min_chars: int = fv.DOCUMENT_MIN_CHARS
