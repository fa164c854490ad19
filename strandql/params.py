"""Search parameters with their defaults, and the overrides of each kind of run."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """Immutable: every query of a batch starts from the same values."""

    # Prefilter: score offset, score units a bit, floor of kept rows, thresholds, cap.
    score_offset: int = 50
    bit_factor: int = 4
    gap_open: int = 20
    gap_extend: int = 4
    min_prefilter_hits: int = 100
    smax_thresh: int = 10
    evalue_coarse: float = 100000.0
    evalue_thresh: float = 1000.0
    max_targets: int = 20000
    # Composite E-value.
    alpha_a: float = 0.4
    alpha_b: float = 0.02
    alpha_c: float = 0.1
    # Hit lists: least and most lines of the summary and of the alignments, probability, E-value.
    z: int = 10
    Z: int = 500
    b: int = 10
    B: int = 500
    p: float = 20.0
    E: float = 1e6
    e: float = 1e-3
    # Alignment.
    local: bool = True
    alternatives: int = 4
    smin: float = 20.0
    shift: float = -0.03
    corr: float = 0.1
    mact: float = 0.35
    egq: float = 0.0
    egt: float = 0.0
    ss_weight: float = 0.11
    min_columns: int = 6
    realign_max: int = 500
    viterbi_band: int = 40
    mac_band: int = 2
    min_overlap: int = 0
    # Alignment filters: identity, coverage, identity and score with the query, diversity.
    max_seqid: int = 90
    coverage: int = 0
    qid: int = 0
    qsc: float = -20.0
    ndiff: int = 1000
    window: int = 25
    # Pseudocounts: residues (admixture a, Neff scale b, exponent c), transitions.
    pca: float = 0.9
    pcb: float = 4.0
    pcc: float = 1.0
    gapb: float = 1.0
    gapd: float = 0.15
    gape: float = 1.0
    gapf: float = 0.6
    gapg: float = 0.6
    gaph: float = 0.6
    gapi: float = 0.6
    background_reach: int = 40
    # Iteration.
    rounds: int = 2
    premerge: int = 3
    neff_max: float = 20.0
    max_seq: int = 65535
    early_stop: bool = True
    filter_thresh: float = 0.01
    block: int = 2000
    gap_percent: int = 50


ITERATIVE = Params()
#: Exhaustive search: no prefilter stage, one round.
EXHAUSTIVE = replace(ITERATIVE, rounds=1, early_stop=False)
#: One query against listed templates.
PAIRWISE = replace(ITERATIVE, alternatives=1, e=1e5, premerge=0, rounds=1, early_stop=False, min_columns=1)
