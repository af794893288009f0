"""Native column expressions used inside the operators."""
