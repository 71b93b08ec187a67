"""Constants of the adaptive-sampling model, and the engine's configuration."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

# Fixed values of the model.
ANCHOR = 400  # bases of a read seen before the decision (mu)
ACQUIRE = 300  # cost of a new read in bases (alpha)
ACQUIRE_ASSEMBLY = 200
REJECT = 300  # cost of a rejection in bases (rho)
BIN = 100
BUCKET = 20_000
START_WINDOW = 2_000
MIN_CONTIG = 100_000
SUBSTITUTION, DELETION, MISSED_DELETION = 0.04, 0.03, 0.1
THETA, DELETION_RATIO = 0.01, 0.4
FULL_DEPTH = 30
MIN_POSITIVE = 2.2250738585072014e-308  # score of a position at full depth
TETRAMER_DISTANCE = 0.036
#: Default partition of read lengths, used until lengths have been seen.
DEFAULT_CCL = (1167, 2729, 3903, 4918, 5866, 6808, 7797, 8912, 10321, 12713)


@dataclass(frozen=True)
class General:
    name: str = "run"
    wait: int = 60
    ref: str | None = None
    mmi: str | None = None
    decision_toml: str | None = None
    barcodes: list[str] = field(default_factory=list)

    def __post_init__(self):
        if " " in self.name:
            raise ValueError("the name of a run must not hold a blank")


@dataclass(frozen=True)
class Live:
    device: str | None = None
    host: str = "localhost"
    port: int = 9502
    data_wait: int = 100


@dataclass(frozen=True)
class Optional_:
    reject_refs: str | None = None
    ploidy: int = 1
    lowcov: int = 10
    temperature: int = 60
    min_seq_len: int = 2500
    min_contig_len: int = 10_000
    min_s1: int = 200
    min_map_len: int = 2000
    tetra: bool = True
    filter_repeats: bool = False
    bucket_threshold: int = 5

    def __post_init__(self):
        if self.ploidy not in (1, 2):
            raise ValueError("ploidy is 1 or 2")


@dataclass(frozen=True)
class Simulation:
    fq: str | None = None
    batchsize: int = 4000
    maxb: int = 400
    binit: int = 5
    dumptime: int = 200_000_000
    paf_full: str | None = None
    paf_trunc: str | None = None
    accept_unmapped: bool = False


@dataclass(frozen=True)
class Config:
    general: General = General()
    live: Live = Live()
    optional: Optional_ = Optional_()
    simulation: Simulation = Simulation()

    @property
    def reference_mode(self) -> bool:
        return bool(self.general.ref)


def read_config(path: str) -> Config:
    """A TOML file of the sections general, live, optional and simulation; an unknown key or a wrong type is an error."""
    raw = tomllib.loads(Path(path).read_text())
    parts = {}
    for f, kind in (("general", General), ("live", Live), ("optional", Optional_), ("simulation", Simulation)):
        given = raw.pop(f, {})
        known = {x.name: x for x in fields(kind)}
        for key, value in given.items():
            if key not in known:
                raise ValueError(f"{f}.{key} is not a setting")
            wanted = known[key].type.split(" | ")[0].split("[")[0]
            if type(value).__name__ != wanted:
                raise ValueError(f"{f}.{key} must be {wanted}")
        parts[f] = kind(**given)
    if raw:
        raise ValueError(f"unknown sections: {sorted(raw)}")
    return Config(**parts)


def write_template(path: str) -> None:
    """A configuration file with every setting at its default."""
    lines = []
    for f in fields(Config):
        lines.append(f"[{f.name}]")
        for x in fields(getattr(Config(), f.name)):
            value = getattr(getattr(Config(), f.name), x.name)
            lines.append(f"# {x.name} =" if value is None else f"{x.name} = {str(value).lower() if isinstance(value, bool) else repr(value)}")
        lines.append("")
    Path(path).write_text("\n".join(lines))
