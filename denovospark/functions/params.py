"""Masses, symbols and tolerances of the annotation, as plain values and as small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Used to remove charge.
HYDROGEN = 1.007
#: Public constants of the closed-form ion simulator, in nano-daltons.
PROTON_N, WATER_N = 1_007_276_466, 18_010_564_684

#: Fixed values of the simulator: neutral losses in nano-daltons, and the residues that lose them.
NEUTRAL_N = {"H2O1": 18_010_564_684, "H3N1": 17_026_549_101}
LOSES = {"H2O1": "STED", "H3N1": "RKNQ"}

# Residues, modifications, losses and series, with the ids of what applies to each residue.
AMINOS = [
    ("G", 57.021463735), ("A", 71.037113805), ("S", 87.032028435), ("P", 97.052763875), ("V", 99.068413945), ("T", 101.047678505), ("C", 103.009184505),
    ("L", 113.084064015), ("I", 113.084064015), ("N", 114.042927470), ("D", 115.026943065), ("Q", 128.058577540), ("K", 128.094963050), ("E", 129.042593135),
    ("M", 131.040484645), ("H", 137.058911875), ("F", 147.068413945), ("R", 156.101111050), ("Y", 163.063328575), ("W", 186.079312980),
]
MODS = [("", 0.0), ("SEP", 97.9769), ("MetOx", 15.9949), ("MetOn", 31.9898)]
LOSSES = [("", 0.0), ("H2O1", 18.0153), ("H3N1", 17.0310), ("C1H2N2", 42.0218), ("C1H2N1O1", 44.0164)]
SERIES = [("b", -1.0079), ("y", -19.0232)]
MODS_OF = {2: [1], 16: [1, 2]}
LOSSES_OF = {2: [2], 5: [2], 9: [1], 11: [1], 12: [1], 13: [2], 17: [1]}

ALPHABET = "ARNDCEQGHLIKMFPSTWYV"


@dataclass(frozen=True)
class AnnotationParams:
    """``max_k``: targets of up to so many residues are searched for; graphs are made of those of one."""

    query_tolerance: float = 0.015
    symmetry_tolerance: float = 0.015
    score_factor: float = 0.75
    charges: tuple[int, ...] = (1, 2, 3)
    max_k: int = 1

    def __post_init__(self) -> None:
        if self.max_k < 1:
            raise ValueError("a target has a residue at least")


@dataclass(frozen=True)
class IonParams:
    """What the simulator makes: series, losses of fragments that hold a residue which loses, whole precursors, charges up to ``max_charge``."""

    series: tuple[str, ...] = ("b", "y")
    losses: bool = False
    precursors: bool = False
    max_charge: int = 1


SIMPLE, COMPLEX = IonParams(), IonParams(losses=True, precursors=True)


@dataclass(frozen=True)
class AlignmentParams:
    cost_threshold: float = 6.0
    node_match: float = 0.0
    node_mismatch: float = 1.0
    edge_match: float = 0.0
    edge_mismatch: float = 1.0
    edge_gap: float = 2.0


@dataclass(frozen=True)
class EnumerationParams:
    cost_threshold: float = 8.0
    max_paths: int | None = None


@dataclass(frozen=True)
class EngineParams:
    annotation: AnnotationParams = field(default_factory=AnnotationParams)
    alignment: AlignmentParams = field(default_factory=AlignmentParams)
    enumeration: EnumerationParams = field(default_factory=EnumerationParams)

    @staticmethod
    def from_dict(tree: dict) -> EngineParams:
        """From a parsed configuration; keys that are absent keep their defaults, unknown ones raise TypeError."""
        annotation = dict(tree.get("annotation", {}))
        if "charges" in annotation:
            annotation["charges"] = tuple(annotation["charges"])
        return EngineParams(AnnotationParams(**annotation), AlignmentParams(**tree.get("alignment", {})), EnumerationParams(**tree.get("enumeration", {})))

    @staticmethod
    def from_yaml(path: str) -> EngineParams:
        import yaml

        with open(path) as f:
            return EngineParams.from_dict(yaml.safe_load(f) or {})
