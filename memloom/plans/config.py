"""Settings, as two named profiles, and their layering."""

from __future__ import annotations

import copy

# Priors, budgets and rates of the model.
RELATION_PRIORS = {
    "documents": 0.9, "specifies": 0.9, "implements": 0.9, "calls": 0.8, "depends_on": 0.8, "inherits": 0.8, "defines": 0.7, "part_of": 0.7,
    "imports": 0.6, "refines": 0.6, "exemplifies": 0.6, "relates_to": 0.5, "follows": 0.4, "supersedes": 0.3, "contradicts": 0.3,
}
RELATION_DEFAULT = 0.5
EDGE_WEIGHT = 0.5
MEMBERSHIP_WEIGHT = 0.7
STATUS_PRIORS = {"active": 1.0, "stale": 1.0, "superseded": 0.2, "disputed": 0.5, "rejected": 0.1}
TIERS = {
    "hub": "strategic", "overview": "strategic", "decision": "strategic", "adr": "strategic", "architectural_pattern": "strategic", "recurring_fix": "strategic",
    "anti_pattern": "strategic", "migration_recipe": "strategic", "module": "tactical", "class": "tactical", "package": "tactical",
    "function": "operational", "section": "operational", "file": "operational", "method": "operational",
}
CODE_TYPES = ("module", "class", "function", "method", "file")
RULING_TYPES = ("decision", "adr")
PATTERN_TYPES = ("architectural_pattern", "recurring_fix", "anti_pattern", "migration_recipe")
RETIRED = ("superseded", "disputed", "rejected")
CONFLICT_RELS = ("contradicts", "supersedes")
GROUND_RELS = ("documents", "implements", "specifies")
HUB_DOWN_RELS = ("documents", "defines", "specifies", "implements", "contains")
HUB_TYPES = ("hub", "overview")
PROTOCOL_METHODS = (
    "__call__", "__enter__", "__exit__", "__getattr__", "__getattribute__", "__setattr__", "__delattr__", "__getitem__", "__setitem__", "__delitem__", "__iter__", "__next__", "__new__", "__init_subclass__",
)
MARKS = {
    "stale": "stale: summary may lag — open the source to verify", "disputed": "disputed: an unresolved contradiction — check the conflicting claim", "rejected": "rejected: arbitration found this claim false",
    "contradicted": "contradicted: source check failed — re-verify before relying", "unverified": "unverified: confirm this code claim against source", "unsure": "low confidence %.2f",
}
PACK_TITLES = {"strategic": "## Strategic — overview & subsystems", "tactical": "## Tactical — relevant modules", "operational": "## Operational — code & detail in focus", "periphery": "## Related (follow if needed)"}
SOURCE_RANKS = {"code": 6, "doc": 5, "data": 5, "user": 5, "chat": 3, "model_inference": 1}

#: What the code falls back on, and what the shipped template sets on top of it.
PROFILES = {
    "defaults": {
        "damping": 0.85, "max_hops": 30, "tolerance": 1e-6, "threshold": 0.02, "seed_floor": 0.0, "compact_ratio": 0.25, "blend": 0.5,
        "budget": {"strategic": 1200, "tactical": 2500, "operational": 6000, "periphery": 40},
        "branch_nodes": 150, "branch_tokens": 60_000, "trivial_lines": 0, "warn_confidence": 0.5,
        "hebbian": 0.10, "decay": 0.02, "prune": 0.05, "near_duplicate": 0.82, "stale_days": 30, "protect_centrality": 0.7,
        "episodic": ("section", "note", "open_question", "plan"), "protect": ("decision", "adr"),
        "linker_top": 5, "linker_similarity": 0.35, "batch_nodes": 80, "batch_units": 60, "batch_chars": 120_000,
        "gate_largest": 0.9, "gate_dangling": 0, "eval_drop": -0.02,
    },
    "template": {"budget": {"strategic": 4000, "tactical": 10_000, "operational": 24_000, "periphery": 60}, "branch_nodes": 400, "branch_tokens": 200_000, "trivial_lines": 3},
}


def merged(base: dict, *layers: dict) -> dict:
    """Later layers win key by key; nested mappings are merged the same way."""
    out = copy.deepcopy(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def profile(name: str = "defaults", **overrides) -> dict:
    return merged(PROFILES["defaults"], PROFILES[name] if name != "defaults" else {}, overrides)
