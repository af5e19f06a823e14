"""Part of corvane; see the README for what lives here."""
