"""Run parameters, and their command-line forms."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class StaticConfig:
    """Parameters of a one-off placement; ``merge_by`` is ``vertices`` or ``classes``.

    ``only_subjects`` leaves vertices that lead nowhere out of the placement of vertices, where triples do not need them.
    """

    k: int = 10
    alpha: float = 0.8
    rounds: int = 5
    cycle_rule: str = "min"
    weight_mode: str = "sum"
    type_predicate: int | None = None
    excluded_objects: tuple[int, ...] = ()
    merge_by: str = "vertices"
    only_subjects: bool = False
    input: str | None = None
    output: str | None = None

    @classmethod
    def from_args(cls, args: list[str]) -> StaticConfig:
        """``--partitionNum --alpha --iterationNum --input --output``; unknown words are ignored."""
        names = {"--partitionNum": ("k", int), "--alpha": ("alpha", float), "--iterationNum": ("rounds", int), "--input": ("input", str), "--output": ("output", str)}
        found = {names[a][0]: names[a][1](b) for a, b in zip(args, args[1:]) if a in names}
        return replace(cls(), **found)


@dataclass(frozen=True)
class EvolutionConfig:
    """Parameters of a placement that follows insertions and deletions."""

    folder: str | None = None
    k: int = 10
    dictionary: str | None = None
    alpha: float = 0.8
    sigma: float = 0.0
    rounds: int = 5
    insert_share: float = 0.0
    delete_share: float = 0.0
    batches: int = 1
    cycle_rule: str = "self"
    weight_mode: str = "normalised"
    type_predicate: int | None = 0
    excluded_objects: tuple[int, ...] = (37,)
    merge_by: str = "classes"

    @classmethod
    def from_args(cls, args: list[str]) -> EvolutionConfig:
        """``--part-num --dict --alpha --sigma --iter --ins --del --evltime folder``; unknown options raise."""
        names = {"--part-num": ("k", int), "--dict": ("dictionary", str), "--alpha": ("alpha", float), "--sigma": ("sigma", float), "--iter": ("rounds", int), "--ins": ("insert_share", float), "--del": ("delete_share", float), "--evltime": ("batches", int)}
        found, rest = {}, list(args)
        while rest:
            word = rest.pop(0)
            if word in names and rest:
                key, kind = names[word]
                found[key] = kind(rest.pop(0))
            elif not word.startswith("--") and "folder" not in found:
                found["folder"] = word
            else:
                raise ValueError(f"unknown option {word}")
        config = replace(cls(), **found)
        if config.insert_share * config.batches >= 1:
            raise ValueError("all batches together must insert less than the whole input")
        return replace(config, dictionary=config.dictionary or (f"{config.folder}/dict" if config.folder else None))
