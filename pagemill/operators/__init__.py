"""DataFrame-to-DataFrame operators; none runs an action."""
