"""Text-fidelity analytics over pairs of texts and their versions, as DataFrame operators."""
