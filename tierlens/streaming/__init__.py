"""No streaming operators: every table query of this engine is bounded."""
