"""The whole of a recommendation: constraints, weights, candidates, ranking, verdicts, stored thread."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import filters, matching, scoring
from ..operators.filters import Clarification
from . import planner

#: Fixed value: products recommended.
PRODUCTS = 8


@dataclass
class Recommendation:
    """Ranked products, or the questions to answer first."""

    ranked: DataFrame | None = None
    questions: list[str] = field(default_factory=list)
    weights: scoring.Weights | None = None
    request: str = ""

    def short(self) -> DataFrame:
        return scoring.short_format(self.ranked)


def recommend(devices: DataFrame, request: str, parse: planner.QueryParser = planner.parse_request, weigh: planner.WeightProvider = planner.keyword_weights, n: int = PRODUCTS, derive_maximum: bool = False, facets: bool = False) -> Recommendation:
    """The n best devices for a request, as a lazy plan: price filter, validation, context, scores, top n.

    A blank request is an error. With derive_maximum a budget alone serves as the maximum price; without, as there is
    no maximum, no device is left. facets also filters by brand, memory and storage.
    """
    if not request.strip():
        raise ValueError("a request is needed")
    query = parse(request)
    weights = query if isinstance(query, Clarification) else weigh(request)
    if isinstance(weights, Clarification):
        return Recommendation(questions=weights.questions, request=request)
    candidates = filters.within_price(devices, query, derive_maximum)
    candidates = filters.with_facets(candidates, query) if facets else candidates
    ranked = scoring.presented(scoring.rank(scoring.enriched(candidates), weights, n))
    return Recommendation(ranked, [], weights, request)


def match_and_rank(listings: DataFrame, devices: DataFrame, weights: scoring.Weights, n: int = 20) -> DataFrame:
    """The n best of the devices that listings match by title."""
    return scoring.rank(matching.enriched_matches(listings, devices), weights, n)


def with_verdicts(found: Recommendation, say: planner.VerdictProvider = planner.score_verdict) -> DataFrame:
    """The ranked products, at most a page of them, each with a verdict."""
    rows = [r.asDict(recursive=True) for r in found.ranked.collect()]  # n rows
    made = [(*(r[c] for c in found.ranked.columns), say(found.weights, found.request, r)) for r in rows]
    schema = StructType([*found.ranked.schema.fields, StructField("verdict", StringType())])
    return found.ranked.sparkSession.createDataFrame(made, schema)
