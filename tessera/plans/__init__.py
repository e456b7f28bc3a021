"""Query plans: derived inputs, the sales star join, reports and the daily run."""
