"""Column functions on genotype strings ``[*]COMPONENTS::ixn_ixn...``, where an interaction is source, target and sign."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, functions as F


def edge_code(state: Column) -> Column:
    """The part after ``::``."""
    return F.substring_index(state, "::", -1)


def components_text(state: Column) -> Column:
    return F.regexp_replace(F.substring_index(state, "::", 1), r"^\*", "")


def components(state: Column) -> Column:
    return F.filter(F.split(components_text(state), ""), lambda c: c != "")


def interactions(state: Column) -> Column:
    """Interactions in the order of the string; an empty array if there are none."""
    return F.filter(F.split(edge_code(state), "_"), lambda x: x != "")


def complexity(state: Column) -> Column:
    """Number of interactions."""
    return F.size(interactions(state))


def is_terminal(state: Column) -> Column:
    return F.startswith(state, F.lit("*"))


def genotype(names: Column, ixns: Column, terminal: bool = True) -> Column:
    """A genotype of component names and an array of interactions, which are sorted."""
    return F.concat(F.lit("*" if terminal else ""), names, F.lit("::"), F.array_join(F.array_sort(ixns), "_"))


def relabellings(motif: str, names: str = "ABC") -> list[list[str]]:
    """All distinct relabellings of a motif's interactions within ``names``; at most the permutations of 5 components."""
    ixns = [x for x in motif.split("::")[-1].split("_") if x]
    found = {tuple(sorted(x[:2].translate(str.maketrans(names, "".join(p))) + x[2] for x in ixns)) for p in permutations(names)}
    return [list(f) for f in sorted(found)]


def has_motif(state: Column, motif: str, names: str = "ABC") -> Column:
    """Whether some relabelling of the motif's interactions is a subset of the state's."""
    own = interactions(state)
    found = F.lit(False)
    for relabelled in relabellings(motif, names):
        found = found | (F.size(F.array_except(F.array(*map(F.lit, relabelled)), own)) == 0)
    return found


def motif_label(flags: dict[str, Column]) -> Column:
    """Names of the motifs that are present joined by ``+``, else ``(none)``."""
    joined = F.concat_ws("+", *[F.when(flag, F.lit(name)) for name, flag in flags.items()])
    return F.when(joined == "", "(none)").otherwise(joined)


def relabel(ixns: Column, names: str, others: str) -> Column:
    """Interactions with each of ``names`` replaced by the letter of ``others`` in its place, sorted."""
    return F.array_sort(F.transform(ixns, lambda x: F.concat(F.translate(F.substring(x, 1, 2), names, others), F.substring(x, 3, 1))))


def canonical(state: Column, names: str = "ABC") -> Column:
    """The least genotype, in code-point order, among all relabellings of the components."""
    relabelled = [F.array_join(relabel(interactions(state), names, "".join(p)), "_") for p in permutations(names)]
    return F.concat(F.lit(f"*{names}::"), F.array_min(F.array(*relabelled)))


def delete_component(state: Column, component: Column | str) -> Column:
    """The genotype without a component and its interactions."""
    one = F.lit(component) if isinstance(component, str) else component
    kept = F.filter(interactions(state), lambda x: ~F.contains(F.substring(x, 1, 2), one))
    star = F.when(is_terminal(state), "*").otherwise("")
    return F.concat(star, F.replace(components_text(state), one, F.lit("")), F.lit("::"), F.array_join(kept, "_"))


#: The known motifs.
MOTIFS: dict[str, str] = {"AI": "ABa_BAi", "AAI": "ABa_BCa_CAi", "III": "ABi_BCi_CAi", "toggle": "ABi_BAi"}


def flags(state: Column, motifs: dict[str, str] | Sequence[str] = MOTIFS, names: str = "ABC") -> dict[str, Column]:
    chosen = motifs if isinstance(motifs, dict) else {m: MOTIFS[m] for m in motifs}
    return {name: has_motif(state, motif, names) for name, motif in chosen.items()}
