"""voxledger.functions"""
