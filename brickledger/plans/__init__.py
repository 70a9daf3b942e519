"""End-to-end plans: analyses, chart tables, findings, training, results."""
