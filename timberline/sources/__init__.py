"""Where lines come from and where entries are kept."""
