"""Names and lookup tables of the data model. Every table carries doc_id; what follows retrieval carries question_id."""

from __future__ import annotations

#: A node is one wide row; columns that its type doesn't have are null.
NODE_TEXT = ("term", "definition", "party", "modal", "action", "right_text", "qualifiers", "limit_text", "condition", "beneficiary", "object_party", "value", "unit", "applies_to", "trigger", "consequence", "field", "context", "ref_to", "describes")
NODE_DDL = "doc_id long, chunk_id long, type string, " + ", ".join(f"{c} string" for c in NODE_TEXT) + ", value_tags array<string>, source_text string, priority string"
EDGE_DDL = "doc_id long, src string, dst string, etype string, weight double"

#: Columns that a node of each type must have.
REQUIRED = {
    "DEFINITION": ("term", "definition"),
    "OBLIGATION": ("party", "modal", "action"),
    "RIGHT": ("party", "right_text"),
    "NUMERIC": ("value", "unit", "applies_to"),
    "CONDITION": ("trigger", "consequence"),
    "BLANK": ("field", "context"),
    "REFERENCE": ("ref_to", "describes"),
}

#: How reliable each kind of edge is, and the weight of kinds not listed.
EDGE_SCALE = {"TRIGGERS": 0.90, "USES_TERM": 0.82, "PARTY_HAS": 0.82, "SAME_SECTION": 0.30, "CONTRADICTS": 0.20}
OTHER_SCALE = 0.65

#: Weights that edges are stored with.
STORED_WEIGHT = {"USES_TERM": 0.8, "TRIGGERS": 0.9, "SAME_SECTION": 0.5, "PARTY_HAS": 0.85}

#: What flows on along each kind of edge, and along kinds not listed.
EDGE_DECAY = {"TRIGGERS": 0.80, "USES_TERM": 0.72, "PARTY_HAS": 0.72, "SAME_SECTION": 0.25, "CONTRADICTS": 0.15}
OTHER_DECAY = 0.50

#: Node types that end a path for each slot.
TERMINAL = {
    "VALUE": ("NUMERIC",),
    "MEANING": ("DEFINITION",),
    "REQUIREMENT": ("OBLIGATION",),
    "PERMISSION": ("RIGHT", "OBLIGATION"),
    "CONSEQUENCE": ("CONDITION", "OBLIGATION"),
    "ACTOR": ("OBLIGATION", "RIGHT"),
    "GENERAL": ("DEFINITION", "OBLIGATION", "RIGHT", "NUMERIC", "CONDITION"),
}

#: Typed steps that also end a path for a slot.
TYPED_STEPS = (
    ("VALUE", "CONDITION", "TRIGGERS", "NUMERIC"),
    ("REQUIREMENT", "CONDITION", "TRIGGERS", "OBLIGATION"),
    ("MEANING", "OBLIGATION", "USES_TERM", "DEFINITION"),
    ("MEANING", "RIGHT", "USES_TERM", "DEFINITION"),
    ("CONSEQUENCE", "CONDITION", "TRIGGERS", "OBLIGATION"),
)

#: Slots that a node type can fill.
PROVIDES = {
    "NUMERIC": ("VALUE",),
    "DEFINITION": ("MEANING",),
    "OBLIGATION": ("PERMISSION", "ACTOR", "REQUIREMENT", "CONSEQUENCE"),
    "RIGHT": ("PERMISSION", "ACTOR"),
    "CONDITION": ("CONSEQUENCE", "TRIGGER", "PERMISSION"),
    "BLANK": ("VALUE", "MEANING"),
    "REFERENCE": ("MEANING", "ACTOR"),
}

#: Node types that answer each slot.
EXPECTED = {
    "PERMISSION": ("RIGHT", "OBLIGATION"),
    "REQUIREMENT": ("OBLIGATION", "CONDITION"),
    "CONSEQUENCE": ("CONDITION", "OBLIGATION"),
    "VALUE": ("NUMERIC",),
    "MEANING": ("DEFINITION", "REFERENCE"),
    "ACTOR": ("OBLIGATION", "RIGHT"),
    "GENERAL": ("DEFINITION", "OBLIGATION", "RIGHT", "NUMERIC", "CONDITION", "REFERENCE"),
}

#: Node types that each kind of question looks at.
BUCKETS = {
    "DEFINITION": ("DEFINITION",),
    "NUMERIC": ("NUMERIC", "CONDITION"),
    "OBLIGATION": ("OBLIGATION", "CONDITION", "REFERENCE", "DEFINITION"),
    "PARTY_SPECIFIC": ("RIGHT", "OBLIGATION", "CONDITION", "REFERENCE", "DEFINITION"),
    "GENERAL": ("DEFINITION", "OBLIGATION", "RIGHT", "NUMERIC", "CONDITION", "BLANK", "REFERENCE"),
}
