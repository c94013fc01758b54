"""Plans composed of operators: retrieval, parallels, dossiers and chain verdicts."""
