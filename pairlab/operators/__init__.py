"""DataFrame operators: joins, resolution, features, selection, evaluation."""
