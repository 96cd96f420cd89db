"""Evidence shapes projected from the given tables, and one checked query per operator."""


def load_checks():
    """Import every check module once and return the filled registry."""
    from caseloom.harness import checks_activity, checks_events, checks_files, checks_functions, checks_registry, checks_sources, registry  # noqa: F401

    return registry
