"""Plans made of operators, and how long ones cut their lineage."""
