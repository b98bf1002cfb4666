"""Recovery passes as DataFrame operators."""
