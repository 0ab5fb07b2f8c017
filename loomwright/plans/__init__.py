"""Plan-shape helpers shared by the operators."""
