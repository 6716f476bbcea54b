"""Settings of a design run: typed fields, derived values, and coercion of loose input by each field's type."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values of the domain's usual protocol."""

    n_pools: int = 2
    min_overlap: int = 10
    mapping: str = "first"
    circular: bool = False
    backtrack: bool = False
    ignore_n: bool = False
    min_base_freq: float = 0.0
    downsample: bool = False
    downsample_target: float = 0.99
    downsample_always_add_prop: float = 0.25
    amplicon_size: int = 400
    amplicon_size_min: int = 0
    amplicon_size_max: int = 0
    high_gc: bool = False
    primer_size_min: int = 19
    primer_size_max: int = 36
    primer_gc_min: int = 30
    primer_gc_max: int = 55
    primer_tm_min: float = 59.5
    primer_tm_max: float = 62.5
    use_annealing: bool = False
    primer_annealing_prop: float = 20.0
    primer_annealing_tempc: float = 65.0
    primer_hairpin_th_max: float = 51.0
    primer_homopolymer_max: int = 5
    primer_max_walk: int = 80
    mismatch_kmersize: int = 19
    mismatch_fuzzy: bool = True
    mismatch_product_size: int = 0
    mv_conc: float = 100.0
    dv_conc: float = 2.0
    dntp_conc: float = 0.8
    dna_conc: float = 15.0
    dimer_score: float = -26.0

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        if self.high_gc:
            for k, v in (("primer_size_min", 17), ("primer_size_max", 30), ("primer_gc_min", 40), ("primer_gc_max", 65)):
                put(k, v)
        if not self.amplicon_size_min:
            put("amplicon_size_min", int(self.amplicon_size * 0.9))
        if not self.amplicon_size_max:
            put("amplicon_size_max", int(self.amplicon_size * 1.1))
        put("mismatch_kmersize", self.primer_size_min)

    @classmethod
    def of(cls, **given) -> Config:
        """Unknown names are ignored and None keeps the default; values are coerced to the default's type."""
        own = {f.name: f.default for f in fields(cls)}
        made = {}
        for k, v in given.items():
            if k in own and v is not None:
                kind = type(own[k])
                made[k] = str(v).lower() == "true" if kind is bool else kind(v)
        return cls(**made)

    def with_(self, **given) -> Config:
        return replace(self, **given)

    def to_dict(self) -> dict:
        return dict(sorted(asdict(self).items()))

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)
