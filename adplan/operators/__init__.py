"""DataFrame-to-DataFrame operators: cleaning, KPIs, breakdowns, joins, time series, health."""
