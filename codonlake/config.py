"""Settings of a task: its kind, its labels with their names, and the threshold above which a label holds.

What a kind says about its labels is a row of ``RULES``; one function applies whichever row it is given.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple

# The names a task is given by, each with the kind it stands for.
KIND_OF = {
    "embedding": "embedding",
    "mask": "mask",
    "generation": "generation",
    "binary": "binary",
    "multiclass": "multiclass",
    "multilabel": "multilabel",
    "regression": "regression",
    "token": "token",
    "binary_classification": "binary",
    "multi_class_classification": "multiclass",
    "multi_label_classification": "multilabel",
    "token_classification": "token",
}


class Rule(NamedTuple):
    """``least`` and ``most`` numbers of labels (None: as given), names where none are given (a ``*`` stands for the number
    of a label), and whether the names must be as many as the labels."""

    least: int | None = None
    most: int | None = None
    names: tuple[str, ...] = ()
    one_each: bool = False


RULES = {
    "embedding": Rule(),
    "token": Rule(),
    "mask": Rule(most=0),
    "generation": Rule(most=0),
    "regression": Rule(1, 1, ("value",), one_each=True),
    "binary": Rule(names=("negative", "positive")),
    "multiclass": Rule(2, None, ("class_*",), one_each=True),
    "multilabel": Rule(2, None, ("label_*",), one_each=True),
}


def labels_of(rule: Rule, labels: int | None, names: tuple[str, ...]) -> tuple[int | None, tuple[str, ...] | None]:
    """The number and the names of a task's labels under a rule."""
    if rule.most == 0:
        return None, None
    if rule.most is not None:
        labels, names = rule.most, ()
    elif rule.least and (labels or 0) < rule.least:
        raise ValueError(f"at least {rule.least} labels are needed")
    if not names or (rule.one_each and len(names) != labels):
        names = tuple(n.replace("*", str(i)) for n in rule.names for i in range(labels if "*" in n else 1))
    return labels or (len(names) or None), names or None


@dataclass(frozen=True)
class TaskSettings:
    """``kind`` may be any name in ``KIND_OF`` and is stored by its kind, so that later steps need to know no other."""

    kind: str = "binary"
    labels: int | None = 2
    label_names: tuple[str, ...] | None = None
    threshold: float = 0.5
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KIND_OF:
            raise ValueError(f"unknown task {self.kind}")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        kind = KIND_OF[self.kind]
        labels, names = labels_of(RULES[kind], self.labels, tuple(self.label_names or ()))
        self.__dict__.update(kind=kind, labels=labels, label_names=names)


def from_mapping(sections: dict[str, Any]) -> TaskSettings:
    """The task of a configuration that was read from a file; entries without a meaning here are kept."""
    entries = dict(sections.get("task") or {})
    meaning = {"task_type": "kind", "num_labels": "labels", "label_names": "label_names", "threshold": "threshold"}
    return TaskSettings(**{ours: entries.pop(theirs) for theirs, ours in meaning.items() if theirs in entries}, extra=entries)
