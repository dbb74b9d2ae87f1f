"""Plans made of several operators: feature pipelines, search, analytics."""
