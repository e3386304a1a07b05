"""Analytics over inventories of text and source artefacts and their change history, as Spark DataFrame operators."""
