"""pushflow: message-delivery dataflows as PySpark DataFrame operators."""
