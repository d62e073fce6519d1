"""The analyses, one module per page of the dashboard they replace."""
