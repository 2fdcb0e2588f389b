"""Domain settings and the fixed values the text and agreement rules rely on."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words ignored by the tokeniser.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "for", "if", "in", "into", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "then", "there", "these", "this", "to", "was", "were", "which", "with",
]

# The six hypothesis dimensions, in rendering order.
DIMENSIONS = ["FAMILY", "ROLE", "EVENT", "QUALIFIER", "SCOPE", "TEMPORAL"]

# Dimension texts that mean "no value".
UNRESOLVED = [
    "", "na", "n/a", "none", "null", "unknown", "unsupported", "unresolved", "not specified", "not applicable",
]

# Other names under which a dimension may be written.
DIMENSION_ALIASES = {
    "accounting_family": "family",
    "state": "event",
    "modifier": "qualifier",
    "dimensional_scope": "scope",
    "time": "temporal",
    "period": "temporal",
}

# Interpretation operators a hypothesis may name.
INTERPRETATION_OPERATORS = [
    "direct_label", "row_column", "relative_time", "roll_forward", "dimensional", "aggregation", "rate", "schedule",
]

# Controlled vocabulary for accounting concepts, dimension -> category -> phrases.
ACCOUNTING_VOCABULARY = {
    "temporal": {
        "instant": ["instant", "as of", "at date", "ending balance", "end of period", "period end"],
        "duration": ["duration", "during", "for the period", "year ended", "three months ended",
                     "six months ended", "nine months ended"],
        "current": ["current", "within one year", "short term", "short-term"],
        "noncurrent": ["noncurrent", "non-current", "long term", "long-term", "after one year"],
        "prior": ["prior", "previous", "preceding", "last year"],
        "future": ["future", "thereafter", "subsequent", "maturities"],
        "year_1": ["year one", "first year", "in year one", "next year"],
        "year_2": ["year two", "second year", "in year two"],
        "year_3": ["year three", "third year", "in year three"],
        "year_4": ["year four", "fourth year", "in year four"],
        "year_5": ["year five", "fifth year", "in year five"],
    },
    "qualifier": {
        "gross": ["gross", "before deductions"],
        "net": ["net", "net of", "after deductions"],
        "total": ["total", "aggregate", "summed", "combined"],
        "component": ["component", "portion", "part", "line item"],
        "current": ["current", "short term", "short-term"],
        "noncurrent": ["noncurrent", "non-current", "long term", "long-term"],
        "pretax": ["pretax", "pre tax", "pre-tax", "before tax", "before income tax"],
        "aftertax": ["aftertax", "after tax", "after-tax", "net of tax"],
        "weighted_average": ["weighted average", "weighted-average"],
        "basic": ["basic"],
        "diluted": ["diluted"],
        "fair_value": ["fair value"],
        "carrying_amount": ["carrying amount", "book value"],
        "accumulated": ["accumulated", "cumulative"],
        "accrued": ["accrued"],
        "deferred": ["deferred"],
        "allowance": ["allowance", "reserve"],
        "impairment": ["impairment", "impaired"],
    },
    "aggregation": {
        "total": ["total", "aggregate", "summed", "combined"],
        "component": ["component", "portion", "part", "line item"],
        "average": ["average", "weighted average", "weighted-average"],
        "minimum": ["minimum", "min"],
        "maximum": ["maximum", "max"],
        "gross": ["gross"],
        "net": ["net"],
    },
    "scope": {
        "segment": ["segment", "reportable segment", "business segment"],
        "geography": ["geography", "geographic", "country", "region", "domestic", "foreign"],
        "class": ["class", "security class", "share class"],
        "plan": ["plan", "benefit plan", "pension plan"],
        "subsidiary": ["subsidiary", "affiliate"],
        "consolidated": ["consolidated"],
        "parent": ["parent"],
    },
    "family": {
        "cash": ["cash", "cash equivalent"],
        "debt": ["debt", "loan", "borrowing", "note payable", "principal"],
        "equity": ["equity", "stock", "share", "common stock", "preferred stock"],
        "revenue": ["revenue", "sales", "income"],
        "expense": ["expense", "cost"],
        "asset": ["asset"],
        "liability": ["liability", "payable", "obligation"],
        "tax": ["tax", "income tax"],
        "lease": ["lease"],
        "inventory": ["inventory"],
        "receivable": ["receivable"],
        "derivative": ["derivative", "hedge"],
        "insurance": ["insurance"],
        "investment": ["investment", "security"],
    },
    "role": {},
    "event": {},
}


@dataclass(frozen=True)
class DomainConfig:
    """Everything that differs between domains; pass one to each job."""

    tag_prefix: str = "us-gaap:"
    vocabulary: dict = field(default_factory=lambda: ACCOUNTING_VOCABULARY)
    dual_modalities: tuple = ("table",)
    k1: float = 1.5
    b: float = 0.75
    coverage_weight: float = 1.0
    pool_multiplier: int = 0
    kappa: float = 60.0
    beta: float = 0.6
    top_k: int = 200
    agreement_top_m: int = 10


# Codes carry no tag prefix; every fact of this domain is ranked by its definition text only.
CLINICAL = DomainConfig(tag_prefix="", vocabulary={}, dual_modalities=())
