"""DataFrame -> DataFrame operators: rules, joins, ranking, resolution, state, audit."""
