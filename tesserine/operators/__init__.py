"""DataFrame -> DataFrame analytic operators (no I/O inside)."""
