"""DataFrame operators: canonicalisation, temporal joins, features, models, blending, graphs, simulation."""
