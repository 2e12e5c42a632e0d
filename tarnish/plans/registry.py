"""All registered queries."""

from tarnish.plans import agent_queries, corruption_queries, feature_queries, model_queries, sketch_queries, stream_queries, sweep_queries

QUERIES = {
    **feature_queries.QUERIES,
    **corruption_queries.QUERIES,
    **sketch_queries.QUERIES,
    **stream_queries.QUERIES,
    **sweep_queries.QUERIES,
    **agent_queries.QUERIES,
    **model_queries.QUERIES,
}
