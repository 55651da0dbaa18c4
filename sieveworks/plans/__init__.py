"""Plans that put operators together, and the configuration that they take."""
